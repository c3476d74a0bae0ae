"""Special functions and distributions."""
