"""textmill: text features, pattern mining, classification and evaluation
as Spark DataFrame / SQL / ML jobs."""

__version__ = "0.1.0"
