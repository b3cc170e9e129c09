"""Millrace: corpus curation and paired evaluation as Spark plans."""
