"""Spark-native peptide search over genomic sequence, and the operators around it."""
