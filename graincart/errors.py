"""Errors of the record engine; messages name the shard where one is known."""


class RecordError(Exception):
    pass


class InvalidOption(RecordError, ValueError):
    pass


class NoShards(RecordError):
    pass


class PoolExhausted(RecordError):
    """A byte limit closed the last writer and no new shard may be made."""


class CorruptBlock(RecordError):
    pass


class InvalidBlockHeader(CorruptBlock):
    """A block header with a right hash and impossible values: never recovered."""


class CorruptChunk(RecordError):
    pass


class BadSignature(RecordError):
    pass


class UnexpectedEnd(RecordError):
    pass


class ClosedWriter(RecordError):
    pass
