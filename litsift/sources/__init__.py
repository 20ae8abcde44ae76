"""litsift.sources."""
