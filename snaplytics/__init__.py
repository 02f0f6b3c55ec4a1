"""Play-by-play team, receiver and award analytics as Spark DataFrame jobs."""
