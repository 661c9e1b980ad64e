"""Operators: ordered and windowed analysis, layouts, grids, signals, scoring."""
