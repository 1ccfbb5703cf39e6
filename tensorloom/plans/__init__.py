"""plans of the tensor engine."""
