"""Social-post sentiment analytics expressed as Spark DataFrame operators."""
