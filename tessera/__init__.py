"""Correlation-network analytics over long-format panels, expressed as Spark plans."""
