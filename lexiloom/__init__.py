"""Text analytics on Spark: retrieval, cleaning, validation, similarity and editorial statistics."""
