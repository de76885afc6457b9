"""What can go wrong."""


class LedgerError(Exception):
    """Any error of the ledger."""


class DuplicateKey(LedgerError):
    """The key has been written before."""


class AppendOnly(LedgerError):
    """Deletes and overwrites are refused."""


class Conflict(LedgerError):
    """Another writer has committed first."""


class NotFound(LedgerError):
    """No such collection, user, session or transaction."""


class Denied(LedgerError):
    """The user lacks the permission, or the session has expired."""


class Invalid(LedgerError):
    """A document or a definition breaks its rules."""


class Aborted(LedgerError):
    """A participant voted against the transaction."""
