"""Recognition results of scanned tickets as Spark tables and streams."""
