"""Archive directories: words, JSON or BSON documents, and flat rows of members."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from satchel.schema import DEFLATE, SHA256
from satchel.sources.bson import Document, Int32, dumps

JSON_WORD, BSON_WORD = 4, 3  # fixed values: the first word of either format
MOST_SIZE = 1 << 63


class ArchiveError(ValueError):
    pass


@dataclass
class Entry:
    path: str
    is_dir: bool = False
    offset: int | None = None
    size: int | None = None
    executable: bool = False
    unpacked: bool = False
    hash: bytes | None = None
    algorithm: int | None = None
    block_size: int | None = None
    blocks: list[bytes] | None = None
    compression: int | None = None
    original_size: int | None = None
    ordinal: int = 0
    children: list[Entry] = field(default_factory=list, repr=False)

    def row(self, archive: str) -> tuple:
        parent, _, name = self.path.rpartition("/")
        integrity = None if self.algorithm is None else (self.algorithm, self.hash, self.block_size, self.blocks)
        compression = None if self.compression is None else (self.compression, self.original_size)
        return (archive, self.ordinal, self.path, name, parent or None, self.path.count("/"), self.is_dir, self.offset, self.size, self.executable, self.unpacked, integrity, compression)


def _number(v: object, what: str) -> int:
    if isinstance(v, str) and v.isdigit():
        v = int(v)
    if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < MOST_SIZE:
        raise ArchiveError(f"{what} is no size: {v!r}")
    return v


def _digest(v: object) -> bytes:
    b = bytes.fromhex(v) if isinstance(v, str) else v
    if not isinstance(b, bytes) or len(b) != 32:
        raise ArchiveError("a hash must have 32 bytes")
    return b


def _algorithm(v: object, name: str, code: int) -> int:
    if v != name and v != code:
        raise ArchiveError(f"unknown algorithm: {v!r}")
    return code


def set_attribute(e: Entry, k: str, v: object) -> None:
    """An attribute other than files."""
    if k in ("offset", "size"):
        setattr(e, k, _number(v, k))
    elif k in ("executable", "unpacked"):
        if not isinstance(v, bool):
            raise ArchiveError(f"{e.path}: {k} must be a boolean")
        setattr(e, k, v)
    elif k == "integrity":
        for a, x in v:
            if a == "algorithm":
                e.algorithm = _algorithm(x, "SHA256", SHA256)
            elif a == "hash":
                e.hash = _digest(x)
            elif a == "blockSize":
                e.block_size = _number(x, a)
            elif a == "blocks":
                e.blocks = [_digest(b) for b in x]
            else:
                raise ArchiveError(f"{e.path}: unknown attribute integrity.{a}")
    elif k == "compression":
        for a, x in v:
            if a == "algorithm":
                e.compression = _algorithm(x, "DEFLATE", DEFLATE)
            elif a == "originalSize":
                e.original_size = _number(x, a)
            else:
                raise ArchiveError(f"{e.path}: unknown attribute compression.{a}")
    else:
        raise ArchiveError(f"{e.path}: unknown attribute {k}")


def flatten(files: Document, base: str = "") -> Iterator[Entry]:
    """Entries in document order, a directory before what it holds. Unknown attributes are errors.

    An explicit stack, so that depth is bounded by memory only.
    """
    stack = [iter([(base + k, v) for k, v in files])]
    n = 0
    while stack:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            continue
        path, attributes = found
        if not isinstance(attributes, Document):
            raise ArchiveError(f"{path}: an entry must be an object")
        e = Entry(path, ordinal=n)
        n += 1
        below = None
        for k, v in attributes:
            if k == "files":
                e.is_dir, below = True, v
            else:
                set_attribute(e, k, v)
        yield e
        if below is not None:
            if not isinstance(below, Document):
                raise ArchiveError(f"{path}: files must be an object")
            stack.append(iter([(f"{path}/{k}", v) for k, v in below]))


def tree(entries: list[Entry]) -> Document:
    """The nested files object of entries, directories made where a path needs them."""
    root = Entry("", is_dir=True)
    dirs = {"": root}

    def directory(path: str) -> Entry:
        missing = []
        while path not in dirs:
            missing.append(path)
            path = path.rpartition("/")[0]
        d = dirs[path]
        for path in reversed(missing):
            dirs[path] = below = Entry(path, is_dir=True)
            d.children.append(below)
            d = below
        return d

    for e in entries:
        if e.is_dir:
            d = directory(e.path)
            d.unpacked |= e.unpacked
        else:
            directory(e.path.rpartition("/")[0]).children.append(e)
    return root


def attributes(e: Entry, bson: bool) -> Document:
    """Of a file, in the order of the format."""
    a = Document([("size", e.size or 0)])
    if e.unpacked:
        a.append(("unpacked", True))
    else:
        a.append(("offset", (e.offset or 0) if bson else str(e.offset or 0)))
    if e.executable:
        a.append(("executable", True))
    if e.algorithm == SHA256:
        digest = (lambda b: b) if bson else bytes.hex
        i = Document([("algorithm", Int32(SHA256) if bson else "SHA256")])
        if e.hash is not None:
            i.append(("hash", digest(e.hash)))
        if e.block_size:
            i.append(("blockSize", e.block_size))
            i.append(("blocks", [digest(b) for b in e.blocks or []]))
        a.append(("integrity", i))
    if e.compression == DEFLATE:
        a.append(("compression", Document([("algorithm", Int32(DEFLATE) if bson else "DEFLATE"), ("originalSize", e.original_size or 0)])))
    return a


def document(entries: list[Entry], bson: bool) -> Document:
    """The directory document."""
    top = Document()
    todo = [(tree(entries), top)]  # a list of its own, so that depth is bounded by memory only
    while todo:
        d, out = todo.pop()
        for e in d.children:
            if e.is_dir:
                below = Document()
                out.append((e.path.rpartition("/")[2], Document([*([("unpacked", True)] if e.unpacked else []), ("files", below)])))
                todo.append((e, below))
            else:
                out.append((e.path.rpartition("/")[2], attributes(e, bson)))
    return Document([("files", top)])


def _json(v: object) -> str:
    out: list[str] = []
    todo: list[object] = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, _Written):
            out.append(x.text)
        elif isinstance(x, Document):
            todo.append(_Written("}"))
            for n, (k, y) in reversed(list(enumerate(x))):
                todo += [y, _Written(("," if n else "") + json.dumps(k) + ":")]
            todo.append(_Written("{"))
        elif isinstance(x, list):
            todo.append(_Written("]"))
            for n, y in reversed(list(enumerate(x))):
                todo += [y, _Written("," if n else "")]
            todo.append(_Written("["))
        else:
            out.append(json.dumps(x))
    return "".join(out)


@dataclass
class _Written:
    text: str


def words(size: int, bson: bool) -> tuple[bytes, bytes]:
    """What stands before and after a document of so many bytes."""
    padded = (size + (0 if bson else 4) + 3) // 4 * 4
    if bson:
        return struct.pack("<3I", BSON_WORD, padded, padded), bytes(padded - size)
    return struct.pack("<4I", JSON_WORD, padded + 4, padded, size), bytes(padded - size)


def header(entries: list[Entry], bson: bool) -> bytes:
    """Words, document and padding, up to where member data start."""
    body = dumps(document(entries, True)) if bson else _json(document(entries, False)).encode()
    before, after = words(len(body), bson)
    return before + body + after
