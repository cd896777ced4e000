"""Analytics over labelled multi-sensor sessions, written as Spark DataFrame jobs."""
