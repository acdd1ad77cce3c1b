"""Preparing and checking corpora of symbolic event sequences on Spark."""
