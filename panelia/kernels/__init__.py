"""Numpy kernels for what is sequential or iterative; each works on one record or one panel in memory."""
