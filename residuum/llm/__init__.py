"""Operators of a training-data pipeline: near-duplicate joins, archives,
decontamination, mixing, boilerplate, token files, nearest neighbours,
toxicity and token counts.  Nothing else in the library imports this package.
"""
