"""inkwell.plans."""
