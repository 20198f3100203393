"""Multilingual news analytics and text enrichment on Spark DataFrames."""
