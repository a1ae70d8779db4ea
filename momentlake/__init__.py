"""momentlake: moment search and artifact indexing as Spark jobs."""
