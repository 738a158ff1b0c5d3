"""Fraud-risk analytics over two independently clocked banking sources, as Spark plans."""
