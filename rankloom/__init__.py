"""rankloom: text matching and ranking as Spark jobs."""
