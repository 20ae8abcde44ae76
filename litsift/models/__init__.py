"""litsift.models."""
