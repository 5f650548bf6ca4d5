"""Errors that the array operators raise, eagerly where metadata suffices."""


class ArrayError(Exception):
    """Base of all."""


class ShapeError(ArrayError, ValueError):
    pass


class AxisError(ShapeError, IndexError):
    pass


class NumericError(ArrayError, ArithmeticError):
    pass


class ModelError(ArrayError, RuntimeError):
    pass
