"""Reading post archives and writing tables."""
