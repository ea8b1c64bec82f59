"""tessera: a Spark-first engine for legal and technical text collections."""
