"""Errors with the numeric codes of the dialect and a place in the statement."""

from __future__ import annotations

#: The codes that clients of the dialect know.
CODES = {
    "InvalidArgument": 1001,
    "Lexical": 2001,
    "Syntax": 2002,
    "Semantic": 2003,
    "IntegerOutOfRange": 2004,
    "PlanStaleSchema": 2005,
    "Catalog": 3001,
    "Storage": 4001,
    "Execution": 5001,
    "Cancelled": 5002,
    "Transaction": 6001,
    "Permission": 7001,
    "NotImplemented": 9001,
    "Internal": 9999,
}


class EngineError(Exception):
    #: Of the statement that failed: rolledBack, or unknown if the store did not say whether it holds the new version.
    commit_state = "rolledBack"

    def __init__(self, kind: str, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{kind} {CODES[kind]}" + (f" at {line}:{column}" if line else "") + f": {message}")
        self.kind, self.code, self.message, self.line, self.column = kind, CODES[kind], message, line, column
