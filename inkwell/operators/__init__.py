"""inkwell.operators."""
