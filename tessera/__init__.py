"""Keyed, versioned tables and their query language, expressed as Spark plans."""
