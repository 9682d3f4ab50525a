"""Content-deduplication and file-inventory analytics on Spark."""
