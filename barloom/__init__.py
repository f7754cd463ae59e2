"""Point-in-time bar analytics as plain DataFrame -> DataFrame functions."""

__version__ = "0.1.0"
