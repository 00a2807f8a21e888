"""A versioned key-value log as Spark DataFrames: runs, scans, history, integrity, sketches and quotas."""
