"""inkwell.sources."""
