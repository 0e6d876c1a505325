"""Sources of the voxel engine."""
