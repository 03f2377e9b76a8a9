"""Errors of the engine."""


class DQFunctionError(Exception):
    """An expression or a rule cannot be evaluated."""
