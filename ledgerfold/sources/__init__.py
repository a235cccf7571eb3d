"""Command logs, transactions and catalogs from tables; versioned tables on disk."""
