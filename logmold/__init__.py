"""logmold: log-template analytics on Spark (DataFrame API, Structured Streaming)."""

__version__ = "0.1.0"
