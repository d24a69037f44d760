"""Errors raised on the driver while a plan is built, or by decoders while it runs."""


class QuarryError(Exception):
    """Any failure of this library."""


class NotFound(QuarryError):
    """A path, column or array does not exist."""


class InvalidFormat(QuarryError):
    """Stored bytes or metadata break their format."""


class DatatypeMismatch(QuarryError):
    """A value has another type than asked for."""


class ShapeError(QuarryError):
    """Shapes or ranks do not fit together."""


class SelectionOutOfBounds(QuarryError):
    """A selection reaches outside its array."""


class UnsupportedFeature(QuarryError):
    """Known, but not provided."""


class LinkResolutionFailed(QuarryError):
    """A link chain is too long or leads nowhere."""


class ResourceLimit(QuarryError):
    """An input exceeds the configured limits."""


#: Decoders refuse chunks above these sizes unless told otherwise.
MAX_CHUNK_BYTES = 64 << 20
MAX_CHUNK_ELEMENTS = 16 << 20
MAX_LINK_HOPS = 40
MAX_TYPE_HOPS = 64
