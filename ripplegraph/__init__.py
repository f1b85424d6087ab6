"""Spark-native impact analysis over tables of facts about source code."""
