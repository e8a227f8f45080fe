"""Readers of calibration inputs and frames derived from the driver tables."""
