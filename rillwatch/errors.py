"""Exceptions raised by the operators."""


class DataError(ValueError):
    """The input table cannot be used as asked (missing column, empty table, unknown strategy)."""


class ModelError(ValueError):
    """A model is untrained, or a model setting is out of range."""
