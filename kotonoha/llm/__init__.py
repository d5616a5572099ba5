"""Operators for preparing training text: scoring, filtering, joining, packing and writing."""
