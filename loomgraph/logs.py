"""Log lines as JSON objects on standard error, by level."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat().replace("+00:00", "Z")
        entry = {"level": record.levelname.lower().replace("warning", "warn"), "timestamp": at, "message": record.getMessage()}
        return json.dumps(entry | getattr(record, "data", {}))


def logger(level: str = "info") -> logging.Logger:
    """The engine's logger; ``level`` is debug, info, warn, error or silent."""
    log = logging.getLogger("loomgraph")
    log.setLevel({"debug": 10, "info": 20, "warn": 30, "error": 40, "silent": 100}[level])
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(_Lines())
        log.addHandler(handler)
        log.propagate = False
    return log


def log(level: str, message: str, **data: object) -> None:
    logging.getLogger("loomgraph").log({"debug": 10, "info": 20, "warn": 30, "error": 40}[level], message, extra={"data": data})
