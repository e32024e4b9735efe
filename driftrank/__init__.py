"""driftrank: change-impact ranking and corpus analytics as Spark plans."""
