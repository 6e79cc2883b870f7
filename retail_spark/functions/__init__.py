"""Column -> Column functions; everything here is a native expression."""
