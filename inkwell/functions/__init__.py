"""inkwell.functions."""
