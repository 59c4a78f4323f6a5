"""Timed-text, frame-series and corpus operators written for Spark DataFrames."""
