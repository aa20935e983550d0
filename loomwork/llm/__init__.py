"""Operators for preparing training data: scanning, filtering, mixing, packing and search."""
