"""litsift.functions."""
