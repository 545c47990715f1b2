"""Spark-native customer-intelligence analytics: tables in, DataFrames out."""
