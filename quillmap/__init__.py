"""Evidence grounding as Spark dataflow."""
