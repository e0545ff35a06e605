"""Leakage-safe analytics over paired events, expressed as Spark DataFrame plans."""
