"""Workplace safety analytics on detection tables and streams, as Spark jobs."""
