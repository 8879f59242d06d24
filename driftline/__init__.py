"""Analytics on sparse, append-only streams of geotagged state changes, as Spark jobs."""
