"""riskloom: card-fraud analytics on Spark (DataFrame, SQL, MLlib, Structured Streaming)."""

__version__ = "0.1.0"
