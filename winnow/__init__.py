"""Record curation on Spark: catalog, decisions, scoring, grouping, selection, retrieval, evaluation."""

__version__ = "0.1.0"
