"""operators of the lodestone engine."""
