"""Panel time-series analytics and corpus preparation as Spark DataFrame jobs."""
