"""Road-traffic sensor history on Spark: ingest, keyed upsert, point and range queries,
vehicle and lane merging, quality rules, gap repair and time windows."""
