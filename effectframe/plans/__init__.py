"""End-to-end jobs made of the operators; stages meet in Parquet tables."""
