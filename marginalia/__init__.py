"""Notes search, retrieval and note-table maintenance as Spark jobs."""
