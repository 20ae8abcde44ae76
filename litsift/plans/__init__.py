"""litsift.plans."""
