"""Prose analytics on Spark: documents in, one DataFrame of diagnostics out."""
