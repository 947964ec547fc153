"""lexweave streaming."""
