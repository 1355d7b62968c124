"""DataFrame operators: browse, count, upsert and model extraction."""
