"""Governed analytics on Spark: from messy multi-source tables to a star schema and metric answers that can be trusted."""
