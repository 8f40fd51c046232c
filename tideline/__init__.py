"""Activity analytics on Spark: windows, gaps, digests, retention, regions and texts as DataFrame operators."""
