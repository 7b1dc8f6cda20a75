"""Errors and the HTTP status that each stands for."""

from __future__ import annotations


class ContentprintError(Exception):
    status = 500


class BadInputError(ContentprintError):
    status = 400


class ForbiddenError(ContentprintError):
    status = 403


class RecordNotFoundError(ContentprintError):
    status = 404


class IncompatibleError(ContentprintError):
    status = 409


class UnsupportedError(ContentprintError):
    status = 501


class UnavailableError(ContentprintError):
    status = 503


STATUS = {e.__name__: e.status for e in (BadInputError, ForbiddenError, RecordNotFoundError, IncompatibleError, UnsupportedError, UnavailableError, ContentprintError)}
