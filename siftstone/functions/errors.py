"""Exceptions, each with the kind that clients see."""

from __future__ import annotations


class SiftError(Exception):
    kind = "bad_input"

    def as_wire(self) -> dict[str, str]:
        return {"kind": self.kind, "message": str(self)}


class IoError(SiftError):
    kind = "io"


class StoreError(SiftError):
    kind = "sql"


class JsonError(SiftError):
    kind = "json"


class PathOutsideRoot(SiftError):
    kind = "path_outside_root"

    def __init__(self, path: str):
        super().__init__(f"path is outside any scanned root: {path}")


class WouldDeleteUniqueCopy(SiftError):
    kind = "would_delete_unique"

    def __init__(self, hash_: str):
        super().__init__(f"refusing to delete only remaining copy of group {hash_}")


class ScanAlreadyRunning(SiftError):
    kind = "scan_running"

    def __init__(self):
        super().__init__("scan already running")


class NoPendingPlan(SiftError):
    kind = "no_pending_plan"

    def __init__(self):
        super().__init__("no scan results available to act on")


class NotConfirmed(SiftError):
    kind = "not_confirmed"

    def __init__(self):
        super().__init__("user did not confirm destructive action")


class BadInput(SiftError):
    kind = "bad_input"

    def __init__(self, message: str):
        super().__init__(f"invalid input: {message}")


class Canceled(SiftError):
    kind = "bad_input"
