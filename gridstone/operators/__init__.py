"""Operators: DataFrame in, DataFrame out, lazy unless they iterate."""
