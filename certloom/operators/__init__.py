"""Operators of the certificate stream; the catalog loads them all in one order, whichever is imported first."""

from .. import catalog  # noqa: F401
