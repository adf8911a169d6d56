"""Where tables come from: CSV, Parquet, and frames that are at hand."""
