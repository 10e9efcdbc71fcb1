"""Spark-native analytics over authorization graphs, policies and activity logs."""
