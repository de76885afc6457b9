"""Where ledgers are kept: Parquet segments that a manifest names."""
