"""What can go wrong with a statement, by when it shows."""


class EngineError(Exception):
    """Any of the errors below."""


class StatementSyntaxError(EngineError):
    """The text isn't a statement; ``line`` and ``column`` count from 1."""

    def __init__(self, line: int, column: int, token: str):
        super().__init__(f"syntax error at line {line}, column {column}: {token!r}" if token else f"syntax error at line {line}, column {column}: unexpected end")
        self.line, self.column, self.token = line, column, token


class SemanticError(EngineError):
    """The statement names something that isn't there, or puts together what doesn't fit."""


class EvaluationError(EngineError):
    """The data broke a rule while the statement ran: division by zero, text used as a number."""
