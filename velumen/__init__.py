"""A PySpark-native engine for image catalogues with embedding vectors, and for training-data corpora."""
