"""Errors that operators raise, before a job runs where they can."""


class TessellaError(Exception):
    """Base of the library's errors."""


class InvalidInput(TessellaError, ValueError):
    """A table or column that an operator can't take."""


class ShapeMismatch(InvalidInput):
    """Columns that a fitted operator misses."""


class NotFitted(TessellaError, RuntimeError):
    """Use of an operator before fit."""


class NotConverged(TessellaError, RuntimeError):
    """An iteration that ended without its tolerance."""


class CorruptModel(TessellaError, ValueError):
    """A stored model whose checksum or kind is wrong."""
