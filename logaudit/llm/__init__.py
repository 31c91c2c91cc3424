"""Training-data operators for large text corpora, as Spark jobs."""
