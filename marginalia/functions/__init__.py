"""Core building blocks; see the modules."""
