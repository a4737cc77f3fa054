"""Errors of the engine; each class has a code of its own."""

from __future__ import annotations


class EngineError(Exception):
    code = "ENGINE_ERROR"


class ParseError(EngineError, ValueError):
    """A file that its parser cannot read."""

    code = "PARSE_ERROR"


class UnsupportedLanguage(EngineError, ValueError):
    """A file extension without a parser."""

    code = "UNSUPPORTED_LANGUAGE"


class ContractError(EngineError, ValueError):
    """A contract that is not there or not as its schema says."""

    code = "CONTRACT_NOT_FOUND"


class SnapshotError(EngineError, ValueError):
    """A snapshot that is not there or not as its schema says."""

    code = "SNAPSHOT_NOT_FOUND"


class OverwriteDenied(ContractError):
    """A change of a contract whose overwrite mode does not allow it."""

    code = "OVERWRITE_DENIED"


class SyncError(EngineError, RuntimeError):
    """A snapshot that does not hold for the files as they are."""

    code = "SYNC_STATE_ERROR"


class NotFound(EngineError, LookupError):
    """A file, module, function or decision that the snapshot does not have."""

    code = "NOT_FOUND"


class AccessDenied(EngineError, PermissionError):
    """A path outside the project."""

    code = "ACCESS_DENIED"
