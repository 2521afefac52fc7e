"""Operators over DataFrames: selection, text, topics, clustering, regression, ranking."""
