"""Sources of the panorama engine."""
