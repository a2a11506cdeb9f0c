"""Mixture-ratings analytics on Spark DataFrames.

A stimulus is a set of (component, dilution, carrier) entries and carries a
vector of ratings.  The package cleans such tables, joins and pools component
vectors, compares ratings with predictions, splits, selects features and fits
one model per rating.  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
