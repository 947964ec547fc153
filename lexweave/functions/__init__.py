"""lexweave functions."""
