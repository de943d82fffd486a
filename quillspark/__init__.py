"""Question-driven analysis of source and text corpora on Spark."""
