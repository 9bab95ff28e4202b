"""quarrymill: data preparation and quality for training corpora, as Spark DataFrame operations."""
