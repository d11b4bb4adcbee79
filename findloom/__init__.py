"""findloom: Spark-native document retrieval, ingestion and evaluation analytics."""
