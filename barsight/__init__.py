"""Session analytics on Spark: price sessions, timed headlines, features, models, positions."""
