"""Whole runs, their results directory, and the query catalogue."""
