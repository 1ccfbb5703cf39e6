"""operators of the tensor engine."""
