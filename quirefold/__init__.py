"""Spark-native corpus curation and transcription evaluation."""
