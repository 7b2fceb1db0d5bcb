"""Readers and writers of the binning pipeline's text formats."""
