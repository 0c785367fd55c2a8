"""agora: discussion analytics (threads, comments, embeddings) as Spark DataFrame jobs."""

__version__ = "0.1.0"
