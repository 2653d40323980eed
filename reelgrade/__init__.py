"""Content-rating analytics for text scripts, expressed as Spark DataFrame plans."""
