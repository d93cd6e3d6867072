"""Lecture-description analytics on Spark: composable DataFrame operators, statistics and checks."""
