"""Streaming of the voxel engine."""
