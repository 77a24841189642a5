"""Streaming of the panorama engine."""
