"""functions of the tensor engine."""
