"""Spark-native analytics over job postings, clickstreams and text corpora."""
