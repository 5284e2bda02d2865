"""Estimators, transformers and metrics over DataFrames."""
