"""Column functions. All are built-in expressions; only similarity.py and normal_key_exact run Python, over Arrow batches of distinct values."""
