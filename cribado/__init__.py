"""Corpus curation on Spark: rate a sample, fit a scoring head, score and filter the whole corpus."""
