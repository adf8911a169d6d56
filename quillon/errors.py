"""What the engine raises; errors of analysis and of running jobs stay Spark's own."""


class EngineError(Exception):
    """Base of the engine's errors."""


class ParseError(EngineError):
    """The text is no statement."""


class BindError(EngineError):
    """Names, types or numbers of columns don't fit."""


class CatalogError(EngineError):
    """A table exists already, or doesn't."""


class UnsupportedStatement(EngineError):
    """A statement of a kind that the engine doesn't have."""
