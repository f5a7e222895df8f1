"""Duskwatch: security-event analytics written as Spark DataFrame jobs."""
