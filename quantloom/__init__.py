"""Market analytics on Spark: features, risk, sentiment, signals and models as DataFrame transformations."""
