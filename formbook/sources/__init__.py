"""Input schemas, table readers and result writers."""
