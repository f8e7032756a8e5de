"""Tessera: retrieval, prompt and cache analytics, and corpus preparation, expressed in Spark."""
