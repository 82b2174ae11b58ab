"""graphloom: a Spark-native engine for building and querying knowledge graphs from documents."""
