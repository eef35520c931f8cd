"""Early warning over network-flow metadata, as Spark DataFrame jobs."""
