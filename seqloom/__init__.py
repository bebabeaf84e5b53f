"""Multiple sequence alignment as Spark jobs."""
