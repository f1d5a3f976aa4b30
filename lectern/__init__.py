"""Document and business analytics as Spark jobs."""
