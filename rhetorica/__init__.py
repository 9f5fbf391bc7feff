"""Rhetorica: text-attribution analytics on Spark."""
