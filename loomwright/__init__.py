"""Spark-native retrieval, matching, guardrail and reporting operators."""
