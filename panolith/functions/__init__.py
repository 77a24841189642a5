"""Functions of the panorama engine."""
