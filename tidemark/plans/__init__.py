"""User-facing layers: store, catalog, cached reads, SQL statements, client."""
