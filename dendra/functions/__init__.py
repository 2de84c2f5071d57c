"""Distance functions as columns and as blocked kernels."""
