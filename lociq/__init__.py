"""Interval, motif and corpus analytics as Spark jobs."""
