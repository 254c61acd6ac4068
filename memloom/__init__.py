"""memloom: analytics over conversational agent memory, expressed as Spark plans."""
