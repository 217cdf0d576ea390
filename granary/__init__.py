"""granary: corpus ingestion, de-duplication and hybrid retrieval as Spark plans."""
