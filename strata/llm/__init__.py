"""Operators for training text. Nothing outside this folder imports it."""
