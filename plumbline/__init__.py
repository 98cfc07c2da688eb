"""Evidence grounding and training-data preparation as Spark plans."""
