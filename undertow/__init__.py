"""undertow: how signals travel between communities and markets, as Spark jobs."""
