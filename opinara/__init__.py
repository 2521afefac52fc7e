"""Opinara: clustering, topic modelling and ranking of short texts on Spark."""
