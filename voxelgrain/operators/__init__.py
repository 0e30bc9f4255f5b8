"""DataFrame operators over pixel, run, component, frame and triangle tables."""
