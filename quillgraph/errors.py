"""Typed errors of the query surface."""


class QueryError(Exception):
    """Base; ``code`` names the kind."""

    code = "query"


class SyntaxProblem(QueryError):
    code = "invalid_query"


class BindingProblem(QueryError):
    code = "unknown_binding"


class SchemaProblem(QueryError):
    code = "schema_violation"


class Unsupported(QueryError):
    code = "unsupported"


class AccessPathMissing(QueryError):
    code = "unavailable_access_path"

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint


class BudgetExceeded(QueryError):
    code = "resource_exhausted"


class StaleCursor(QueryError):
    code = "stale_cursor"


class Conflict(QueryError):
    code = "conflict"
