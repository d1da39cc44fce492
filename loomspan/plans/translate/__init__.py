"""Agent events of each source made into span operations."""
