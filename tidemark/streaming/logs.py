"""Logs as JSON lines on stderr, each with what has been bound to them, such as a run's id."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "fields", {})}
        return json.dumps(line, default=str)


class _Stderr(logging.StreamHandler):
    """Writes to what ``sys.stderr`` is at the time."""

    def __init__(self):
        super().__init__(sys.stderr)

    def emit(self, record: logging.LogRecord) -> None:
        self.stream = sys.stderr
        super().emit(record)


class Bound(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        own = {k: kwargs.pop(k) for k in [*kwargs] if k not in ("exc_info", "stack_info", "stacklevel", "extra")}
        return msg, {**kwargs, "extra": {"fields": {**(self.extra or {}), **own}}}

    def bind(self, **more) -> Bound:
        return Bound(self.logger, {**(self.extra or {}), **more})


def json_logger(name: str = "tidemark", **fields) -> Bound:
    log = logging.getLogger(name)
    if not any(isinstance(h, _Stderr) for h in log.handlers):
        handler = _Stderr()
        handler.setFormatter(JsonFormatter())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return Bound(log, fields)
