"""Derived views of the driver's tables, the query catalogue and its SQL."""
