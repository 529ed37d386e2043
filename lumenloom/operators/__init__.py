"""DataFrame operators built from the functions."""
