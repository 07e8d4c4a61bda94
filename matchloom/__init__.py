"""Draft and match analytics on Spark: validation, identity, features, models, scoring, text and streams."""
