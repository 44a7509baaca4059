"""Spark-native analytics for public-transport timetables, live delays and text corpora."""
