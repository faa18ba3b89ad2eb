"""Batch operators, grouped by the phase of a table change they serve."""
