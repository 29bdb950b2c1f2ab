"""DNS-log analytics and domain classification as Spark DataFrame jobs."""
