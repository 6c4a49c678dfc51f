"""Demand-planning analytics expressed as Spark DataFrame plans."""
