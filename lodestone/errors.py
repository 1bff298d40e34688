"""What can go wrong."""


class LodestoneError(Exception):
    """Base of all errors that this library raises itself."""


class PredicateError(LodestoneError, ValueError):
    """A predicate can't be read."""


class PredicateTypeError(PredicateError, TypeError):
    """A predicate compares values that have no order in common."""


class IntegrityError(LodestoneError):
    """Stored data contradict their hashes, counts or bounds."""


class OutOfSyncError(IntegrityError):
    """Tokens belong to documents that aren't there."""


class DuplicateViewError(LodestoneError, ValueError):
    """A tokenizer has a view already."""


class ShardChangedError(LodestoneError, ValueError):
    """A shard that is registered has other contents now."""


class ExcludedError(LodestoneError, ValueError):
    """The document is excluded from the dataset."""


class UnsupportedVersionError(LodestoneError, ValueError):
    """The table format is of a version that this library doesn't read."""


class MissingDependencyError(LodestoneError, ImportError):
    """An optional package isn't installed."""
