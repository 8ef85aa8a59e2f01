"""Context retrieval and training-data preparation on Spark."""
