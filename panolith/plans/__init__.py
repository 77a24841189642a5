"""Plans of the panorama engine."""
