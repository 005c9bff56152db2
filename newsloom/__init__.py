"""Article ranking, story grouping and source monitoring as PySpark DataFrame jobs."""
