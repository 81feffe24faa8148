"""Named queries over a data directory, with their SQL."""
