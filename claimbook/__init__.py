"""Actuarial analytics expressed as Spark DataFrame jobs."""
