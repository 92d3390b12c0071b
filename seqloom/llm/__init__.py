"""Operators for preparing training corpora at scale; see the modules for each method."""
