"""Brevier: news and document intelligence as Spark DataFrame operators."""
