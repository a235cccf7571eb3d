"""ledgerfold: ordered, versioned key-value data and its command log as Spark DataFrames."""
