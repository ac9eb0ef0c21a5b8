"""lakeloom: a relational engine whose plans are Spark DataFrame and SQL plans."""

__version__ = "0.1.0"
