"""What can be wrong with a corpus, a table or a parameter."""


class CorpusError(Exception):
    """Base of all errors of this package."""


class ValidationFailed(CorpusError, ValueError):
    """A parameter or a table isn't what an operator needs."""


class SchemaMismatch(ValidationFailed):
    """Columns or types of a table differ from those expected."""


class TaggerMismatch(CorpusError):
    """The tagger doesn't do what the parser needs."""


class SourceFailed(CorpusError, OSError):
    """A folder or file can't be read."""


class DuplicateDocuments(ValidationFailed):
    """Two documents have the same id."""


class CorpusWarning(UserWarning):
    """Something that works, but may not be what was meant."""


class SizeWarning(CorpusWarning):
    """Something large enough to take long."""
