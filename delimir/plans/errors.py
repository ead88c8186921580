"""Errors of the engine."""


class DelimitedError(ValueError):
    """Bad options, a bad filter or input that breaks the rules asked for."""
