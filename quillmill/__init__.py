"""A PySpark-native machine-learning engine on DataFrames."""
