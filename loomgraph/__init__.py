"""Code-graph and change-history analytics, and training-data preparation, on Spark."""
