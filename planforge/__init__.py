"""Spark-native statistics, bounds, plan decisions and workloads for select-project-join queries."""
