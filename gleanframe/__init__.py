"""Web-corpus analytics as Spark plans: discovery, extraction, filtering and data preparation."""

__version__ = "0.1.0"
