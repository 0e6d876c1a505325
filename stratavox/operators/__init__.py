"""Operators of the voxel engine."""
