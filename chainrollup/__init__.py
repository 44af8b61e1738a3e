"""Activity analytics on block-structured event logs, as Spark DataFrame jobs."""
