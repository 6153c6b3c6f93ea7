"""mediasift: media-integrity analytics over tables and streams, on Spark.

Operators are functions from DataFrame to DataFrame, generic over column
names. See README.md for the map of modules.
"""
