"""Ready-made plans: the query catalogue."""
