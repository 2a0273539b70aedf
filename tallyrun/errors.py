"""Errors with the codes that clients match on."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str, path: str = "", errors: list[dict] | None = None):
        super().__init__(f"{code}: {message}" + (f" (at {path})" if path else ""))
        self.code, self.message, self.path, self.errors = code, message, path, errors or []


class RegistrationError(EngineError):
    """A catalogue that cannot be installed; `errors` lists all that was found."""


class ValidationError(EngineError):
    """An event or a read that does not fit the catalogue."""
