"""sources of the tensor engine."""
