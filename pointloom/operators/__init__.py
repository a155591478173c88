"""Operators on point DataFrames: columns are dimensions, ``pid`` is row order, ``view`` groups rows."""
