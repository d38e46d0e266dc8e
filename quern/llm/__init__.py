"""Operators for preparing training data at corpus scale. Nothing else in quern imports this package."""
