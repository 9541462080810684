"""Document and vector analytics expressed as Spark plans."""
