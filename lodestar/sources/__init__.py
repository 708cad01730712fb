"""Readers to staged text and writers of its formats."""
