"""lorespark: knowledge retrieval, context packing and corpus analytics as Spark plans."""
