"""latticeq: Spark-native retrieval analytics over catalogs of files, vectors and scores."""

__version__ = "0.1.0"
