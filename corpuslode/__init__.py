"""Corpus analytics on Spark: rule scans, import graphs, coverage, conventions,
relevance packing, advisory joins and architecture roll-ups over many projects."""

__version__ = "0.1.0"
