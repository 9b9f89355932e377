"""Outdoor-safety risk analytics for many locations at once, as Spark DataFrame jobs."""
