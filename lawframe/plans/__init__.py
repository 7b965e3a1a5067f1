"""Named queries and their SQL twins."""
