"""Spark-native engine for finding, classifying, masking and restoring personal data in text."""
