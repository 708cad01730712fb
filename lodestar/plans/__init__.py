"""Governed metrics: closed measures, privacy, validated questions, certified answers; and the catalogue of queries."""
