"""functions of the content-rating engine."""
