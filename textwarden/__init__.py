"""Content-moderation and corpus analytics as Spark DataFrame operators."""
