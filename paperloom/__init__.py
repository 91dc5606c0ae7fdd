"""Document analytics on Spark: every stage is a DataFrame operator over all documents at once."""
