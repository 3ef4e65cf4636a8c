"""Operators over boxes, vectors, tracks and selections."""
