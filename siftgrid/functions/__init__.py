"""Part of siftgrid."""
