"""The audit operators, by subject."""
