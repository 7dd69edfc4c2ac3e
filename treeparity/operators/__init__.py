"""Operators on relations shaped like trees: comparison, reports, order and rechecks."""
