"""Analytics over site-by-sample matrices on Spark."""
