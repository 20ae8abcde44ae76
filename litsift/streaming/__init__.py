"""litsift.streaming."""
