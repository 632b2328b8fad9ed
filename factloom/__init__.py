"""Spark-native engine for facts about software designs."""
