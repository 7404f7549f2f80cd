"""Analytics over the long-term memory of software agents, as Spark plans."""
