"""Errors of the engine."""


class EngineError(Exception):
    """Any error that the engine itself raises."""


class ParseError(EngineError):
    """The text is not a statement of the dialect."""


class BindError(EngineError):
    """A table, column or function is not there, or is ambiguous."""


class ConstraintError(EngineError):
    """A write would break a constraint; nothing was written."""


class TransactionError(EngineError):
    """BEGIN inside a transaction, or COMMIT or ROLLBACK outside one."""


class UnsupportedError(EngineError):
    """The statement is understood, but not supported."""
