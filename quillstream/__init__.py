"""Event-log queries and analytics as Spark plans."""
