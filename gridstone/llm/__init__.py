"""Training-data operators over document tables. Nothing outside this package imports it."""
