"""Functions of the voxel engine."""
