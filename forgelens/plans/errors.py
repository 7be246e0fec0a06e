"""What can go wrong for a caller, as exceptions with a status, a code and a hint."""

from __future__ import annotations

from ..operators.relational import checked_rating, checked_score  # noqa: F401  their ValueErrors are Invalid to a caller
from ..sources.tables import Conflict
from .jobs import Busy


class Invalid(ValueError):
    """A request that cannot be meant."""


class NotFound(LookupError):
    """There is no such row."""

    def __init__(self, kind: str, key: str):
        super().__init__(f"no {kind} {key}")


class Corrupt(RuntimeError):
    """What is stored is not what was written."""


#: (status, code, hint) of each kind, the narrower ones first.
KNOWN: list[tuple[type[BaseException], int, str, str]] = [
    (NotFound, 404, "not_found", "it may have been removed; reload the list"),
    (Busy, 409, "busy", "wait for the running job, or cancel it"),
    (Conflict, 409, "conflict", "another change came first; look again and repeat"),
    (Corrupt, 500, "corrupt", "run the analysis again"),
    (FileNotFoundError, 404, "no_folder", "check the folder's name, and that this machine sees it"),
    (PermissionError, 403, "forbidden", "give the engine the right to read it"),
    (TimeoutError, 504, "timeout", "try again later"),
    (ValueError, 400, "invalid", "check the request's values"),
]


def described(error: BaseException) -> dict[str, str | int]:
    """status, code, message and hint; what is not known is an internal error, whose message
    stays inside."""
    for kind, status, code, hint in KNOWN:
        if isinstance(error, kind):
            return {"status": status, "code": code, "message": str(error), "hint": hint}
    return {"status": 500, "code": "internal", "message": "internal error", "hint": "see the log"}
