"""strandline: a PySpark-native engine for corpus, retrieval and routing analytics."""
