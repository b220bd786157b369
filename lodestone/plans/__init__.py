"""plans of the lodestone engine."""
