"""Web-page analytics on Spark: text, links, entities, relevance, quality, event health."""

__version__ = "0.1.0"
