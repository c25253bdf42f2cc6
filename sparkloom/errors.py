"""The engine's errors."""


class EngineError(Exception):
    """Any failure of the engine."""


class ConfigurationError(EngineError):
    """A setting that cannot hold."""


class ParsingError(EngineError):
    """A source that cannot be read as what it should be."""


class IndexingError(EngineError):
    """A table that cannot be built or written."""


class QueryError(EngineError):
    """A question that cannot be planned or answered."""


class PortError(EngineError):
    """A failure of a plugged-in model."""
