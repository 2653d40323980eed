"""streaming of the content-rating engine."""
