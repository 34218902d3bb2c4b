"""Page-corpus analytics on Spark: frontier, robots, extraction, cleaning, validation, storage, export."""

__version__ = "0.1.0"
