"""The five error kinds of the engine."""


class EngineError(Exception):
    """Base of all errors raised by this package."""


class AlreadyExists(EngineError):
    """A table, view or key is there already."""


class NotFound(EngineError):
    """No such table, view, version or statement."""


class InvalidArgument(EngineError):
    """A malformed command, unknown column or unsupported type."""


class Internal(EngineError):
    """An engine failure that the caller cannot mend."""


class Unimplemented(EngineError):
    """A defined but unsupported call."""
