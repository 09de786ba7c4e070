"""hindcast: search, listings, transcripts, retention and storage upkeep over
activity records, written as Spark DataFrame operators."""

__version__ = "0.1.0"
