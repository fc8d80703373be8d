"""Spark-native text retrieval, lexicon matching, sequence analytics and manifest roll-ups."""
