"""Text-corpus analytics as Spark jobs."""
