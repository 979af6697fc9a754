"""Operators of a training-data pipeline. Nothing else in siltworks imports this."""
