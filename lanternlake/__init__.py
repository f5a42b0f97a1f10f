"""Evidence retrieval, change and incident analytics as lazy Spark plans."""
