"""Operators for training-data pipelines over text; nothing outside this folder imports them."""
