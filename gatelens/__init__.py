"""Security analytics over access logs, written as Spark DataFrame and Structured Streaming jobs."""

from gatelens.config import Policy

__all__ = ["Policy"]
