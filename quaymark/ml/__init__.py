"""Estimators of quality on MLlib."""
