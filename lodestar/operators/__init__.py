"""Distance, selection, join and verification operators."""
