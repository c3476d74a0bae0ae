"""Readers and writers of the file formats that the engine knows beside Spark's own."""
