"""Gristmill: market-research and content-quality analytics on Spark."""
