"""sources of the content-rating engine."""
