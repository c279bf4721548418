"""Document, graph and retrieval analytics as Spark jobs."""
