"""Training data from documents by way of a typed knowledge graph, as Spark jobs."""
