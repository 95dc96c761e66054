"""Race-form analytics on Spark: cleaning, point-in-time form, deviation scores, training and scoring."""

__version__ = "0.1.0"
