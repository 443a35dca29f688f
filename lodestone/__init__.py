"""Lodestone: document retrieval and corpus preparation as Spark DataFrame programs."""
