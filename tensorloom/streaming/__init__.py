"""streaming of the tensor engine."""
