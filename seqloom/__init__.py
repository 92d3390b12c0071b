"""seqloom: Spark jobs for sequential and generative recommendation data."""

__version__ = "0.1.0"
