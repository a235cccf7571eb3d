"""Operators over command logs, states, shard catalogs, transactions and histories."""
