"""Compositions users call: clean, slice, reports and the dashboard bundle."""
