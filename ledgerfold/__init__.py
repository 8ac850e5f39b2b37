"""Change-record analytics and corpus preparation as Spark jobs."""
