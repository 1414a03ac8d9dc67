"""Spark-native semantic analytics: facts, evidence, rules, queries and statistics as DataFrame jobs."""
