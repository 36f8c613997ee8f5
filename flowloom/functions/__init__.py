"""Analytics of experiment runs."""
