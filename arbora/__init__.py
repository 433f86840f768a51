"""arbora: contextual-bandit analytics as Spark DataFrame jobs."""
