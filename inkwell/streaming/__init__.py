"""inkwell.streaming."""
