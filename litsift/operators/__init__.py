"""litsift.operators."""
