"""What callers can get wrong."""


class InvalidArgument(ValueError):
    """A value outside its domain."""


class Unsupported(NotImplementedError):
    """A construct that is refused by name rather than answered wrongly."""


class NotFound(KeyError):
    """A collection or point that is not there."""


class AlreadyExists(ValueError):
    """A collection of that name is there."""
