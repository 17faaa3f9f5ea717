"""Plan helpers and the query registry."""
