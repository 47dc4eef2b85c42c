"""Spark-native lexical retrieval, coverage analytics and ranking evaluation."""
