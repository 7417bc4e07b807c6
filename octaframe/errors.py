"""Statuses of codec operations."""

OK, INVALID_ARG, MEMORY, LIMIT = "OK", "INVALID_ARG", "MEMORY", "LIMIT"
CORRUPT, UNSUPPORTED, INTERNAL, IO = "CORRUPT", "UNSUPPORTED", "INTERNAL", "IO"
STATUSES = (OK, INVALID_ARG, MEMORY, LIMIT, CORRUPT, UNSUPPORTED, INTERNAL, IO)


class CodecError(ValueError):
    """An operation that ended with a status other than OK."""

    def __init__(self, status: str, detail: str):
        super().__init__(f"{status}: {detail}")
        self.status, self.detail = status, detail

    def __reduce__(self):
        return CodecError, (self.status, self.detail)


def corrupt(detail: str) -> CodecError:
    return CodecError(CORRUPT, detail)
