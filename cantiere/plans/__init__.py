"""Bound plans: test-table bindings, the national pipeline, the query catalogue."""
