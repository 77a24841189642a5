"""Operators of the panorama engine."""
