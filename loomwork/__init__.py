"""Analytics over conversational, commerce and speech-corpus tables, as Spark jobs."""
