"""Errors a caller may want to tell apart."""


class StructlensError(Exception):
    """Any error of the ingest and artifact layers."""


class AuthenticationError(StructlensError):
    """The source refused the credentials, or none were given."""


class NotFoundError(StructlensError):
    """The source has no such item."""


class ResponseError(StructlensError):
    """The source kept failing after all retries."""


class TamperedError(StructlensError):
    """A stored artifact's content no longer has the id it is stored under."""


class SchemaDriftError(StructlensError):
    """Columns and dictionary name different fields."""
