"""Errors that callers may catch; all but a failed load are also ValueErrors."""


class ProbeError(Exception):
    """Base of all errors of this package."""


class SettingsError(ProbeError, ValueError):
    """A setting has a wrong type or value."""


class TableError(ProbeError, ValueError):
    """A table can't be examined, such as one without rows."""


class StrictJsonError(ProbeError, ValueError):
    """A value doesn't survive strict JSON."""


class LoadError(ProbeError):
    """A file can't be read as a table."""
