"""Metagenome binning analytics and training-data operators as Spark plans."""
