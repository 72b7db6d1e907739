"""Spark-native analytics over per-read allele observations and the tables around them."""
