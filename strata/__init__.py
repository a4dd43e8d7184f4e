"""Spark-native analytics over governed reference data and documents."""
