"""Errors with a stable code."""

from __future__ import annotations


class RecordError(Exception):
    """An error with a ``code`` and optional details."""

    def __init__(self, code: str, message: str = "", **details: object):
        super().__init__(message or code)
        self.code, self.details = code, details

    def as_dict(self) -> dict:
        return {"name": type(self).__name__, "code": self.code, "message": str(self), "details": self.details}


class SourceError(RecordError): ...


class TrainingError(RecordError): ...


class ExportError(RecordError): ...
