"""Base tables: schemas, readers, dashboard views, and adapters for the test tables."""
