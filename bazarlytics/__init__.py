"""Marketplace analytics on Spark: star schema, marts, analyses, data checks and run history."""
