"""Customer churn and lifetime-value analytics as Spark jobs."""
