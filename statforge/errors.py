"""Errors raised by parameter checks and fits."""


class StatError(ValueError):
    """The base of all errors of this package."""


class InvalidParameter(StatError):
    """A parameter is outside its range."""


class NotEnoughSamples(StatError):
    """The data hold no rows, or too few."""


class MismatchedShapes(StatError):
    """Two inputs differ in length or width."""


class NotConverged(StatError):
    """An iteration ended without meeting its tolerance; ``model`` is what it had."""

    def __init__(self, message: str, model: object = None):
        super().__init__(message)
        self.model = model


class TooLarge(StatError):
    """The input is larger than a method that runs in one task may take."""


class InvalidLabels(StatError):
    """Too few or too many classes, or values that no model can use."""


def require(ok: bool, message: str, kind: type[StatError] = InvalidParameter) -> None:
    if not ok:
        raise kind(message)
