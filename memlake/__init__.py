"""memlake: session-knowledge analytics as Spark DataFrame jobs and streams."""
