"""Operators on DataFrames: coverage, composition, markers, seeds, evaluation."""
