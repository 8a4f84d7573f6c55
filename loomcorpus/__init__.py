"""loomcorpus: building, auditing and searching text corpora as Spark DataFrame jobs."""
