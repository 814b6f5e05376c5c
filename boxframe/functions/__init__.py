"""Column functions: geometry of boxes, and parsing of names, keys and replies."""
