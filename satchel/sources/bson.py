"""The part of BSON that archive directories use, by recursive descent over pairs.

Documents are lists of (key, value), so that order and repeated keys stay;
arrays are lists of values. Integers that fit 31 bits can be int32, all
others are int64; an Int32 forces the short form.
"""

from __future__ import annotations

import struct


class Int32(int):
    pass


class Document(list):
    """(key, value) pairs in order."""


class BsonError(ValueError):
    pass


class BsonEnds(BsonError):
    """The bytes at hand end within a value."""


# Element codes of the format.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, BOOLEAN, NULL, INT32, INT64 = 0x01, 0x02, 0x03, 0x04, 0x05, 0x08, 0x0A, 0x10, 0x12


def dumps(pairs: Document) -> bytes:
    """Lists are documents with keys 0, 1, ...; an explicit stack, so that depth is bounded by memory only."""
    out = bytearray(4)
    stack = [(0, iter(pairs))]
    while stack:
        start, rest = stack[-1]
        found = next(rest, None)
        if found is None:
            out.append(0)
            struct.pack_into("<i", out, start, len(out) - start)
            stack.pop()
            continue
        key, v = found
        code, data = _element(v)
        out += bytes([code]) + key.encode() + b"\0" + data
        if code in (DOCUMENT, ARRAY):
            stack.append((len(out) - 4, iter(v if code == DOCUMENT else [(str(i), x) for i, x in enumerate(v)])))
    return bytes(out)


def _element(v: object) -> tuple[int, bytes]:
    """Code and bytes of a value; of a document or list the room for its length only."""
    if v is None:
        return NULL, b""
    if isinstance(v, bool):
        return BOOLEAN, bytes([v])
    if isinstance(v, Int32):
        return INT32, struct.pack("<i", v)
    if isinstance(v, int):
        return INT64, struct.pack("<q", v)
    if isinstance(v, float):
        return DOUBLE, struct.pack("<d", v)
    if isinstance(v, str):
        s = v.encode() + b"\0"
        return STRING, struct.pack("<i", len(s)) + s
    if isinstance(v, bytes):
        return BINARY, struct.pack("<iB", len(v), 0) + v
    if isinstance(v, Document):
        return DOCUMENT, bytes(4)
    if isinstance(v, list):
        return ARRAY, bytes(4)
    raise BsonError(f"no BSON form for {type(v).__name__}")


def loads(data: bytes) -> Document:
    """The document at the start of data; its length word is not trusted, terminators decide."""
    return value(data, 0, DOCUMENT)[0]


def value(data: bytes, at: int, code: int) -> tuple[object, int]:
    """The value of an element that begins at a position, and where it ends."""
    if code not in (DOCUMENT, ARRAY):
        return _value(data, at, code)
    top, at = Document(), at + 4
    stack: list[tuple[Document, bool]] = [(top, code == ARRAY)]  # what is open, and whether it is a list
    while True:
        if at >= len(data):
            raise BsonEnds("document ends early")
        code, at = data[at], at + 1
        if not code:
            done, is_list = stack.pop()
            if not stack:
                return ([v for _, v in top] if is_list else top), at
            if is_list:
                above = stack[-1][0]
                above[-1] = (above[-1][0], [v for _, v in done])
            continue
        end = data.find(0, at)
        if end < 0:
            raise BsonEnds("key ends early")
        key, at = data[at:end].decode(), end + 1
        if code in (DOCUMENT, ARRAY):
            below = Document()
            stack[-1][0].append((key, below))
            stack.append((below, code == ARRAY))
            at += 4
            continue
        found, at = _value(data, at, code)
        stack[-1][0].append((key, found))


def _value(b: bytes, at: int, code: int) -> tuple[object, int]:
    try:
        if code == NULL:
            return None, at
        if code == BOOLEAN:
            return b[at] != 0, at + 1
        if code == INT32:
            return Int32(struct.unpack_from("<i", b, at)[0]), at + 4
        if code == INT64:
            return struct.unpack_from("<q", b, at)[0], at + 8
        if code == DOUBLE:
            return struct.unpack_from("<d", b, at)[0], at + 8
        if code == STRING:
            n = struct.unpack_from("<i", b, at)[0]
            if n < 0:
                raise BsonError("a string of no length")
            if at + 4 + n > len(b):
                raise BsonEnds("string ends early")
            return b[at + 4 : at + 3 + n].decode(), at + 4 + n
        if code == BINARY:
            n = struct.unpack_from("<i", b, at)[0]
            if n < 0:
                raise BsonError("a binary of no length")
            if at + 5 + n > len(b):
                raise BsonEnds("binary ends early")
            return bytes(b[at + 5 : at + 5 + n]), at + 5 + n
    except (struct.error, IndexError) as e:
        raise BsonEnds("value ends early") from e
    raise BsonError(f"element code {code:#x}")
