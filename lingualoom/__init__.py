"""PySpark analytics over word-level and token-level language data."""
