"""Incremental runs of the batch operators. The batch engine needs none of this."""
