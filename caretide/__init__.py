"""Acute-care analytics on Spark: keyed reads, worklists, flags, matrices, scores, gates and change logs."""
