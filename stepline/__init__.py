"""stepline: labelled decision steps as Spark jobs."""
