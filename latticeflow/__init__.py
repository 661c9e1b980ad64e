"""Event and time-series analytics over many independent entities, as Spark plans."""
