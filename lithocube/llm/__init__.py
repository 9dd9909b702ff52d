"""Operators for training texts: splits, packing, mixing and one form for look-alike text."""
