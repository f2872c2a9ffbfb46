"""Live captures as streams."""
