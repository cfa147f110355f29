"""Point-in-time revision analytics for Apache Spark."""
