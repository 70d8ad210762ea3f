"""Analytics over coding-agent session logs, expressed as Spark DataFrame jobs."""
