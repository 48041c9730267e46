"""Spatio-temporal activity analytics on Spark."""
