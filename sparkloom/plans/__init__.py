"""Named queries and multi-step transactions."""
