"""operators of the content-rating engine."""
