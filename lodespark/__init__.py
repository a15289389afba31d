"""Spark-native data mining: DataFrame operators, sources, functions, plans and streams."""
