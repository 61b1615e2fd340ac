"""Archive directories as streams: read an entry at a time, written an entry at a time.

Memory goes with the depth and the largest entry, not with the directory.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from json.decoder import scanstring
from typing import BinaryIO

from satchel.sources import bson
from satchel.sources.directory import BSON_WORD, JSON_WORD, ArchiveError, Entry, _json, attributes, set_attribute
from satchel.sources.bson import Document

#: Bytes of a directory that are taken from the file at once.
CHUNK = 1 << 18


class Ends(ArchiveError):
    """What is at hand ends within an element, or is no JSON."""


class JsonForm:
    """Places in a text. What follows a value must be at hand, so that no number is cut."""

    word, start = JSON_WORD, 0
    _space = re.compile(r"[ \t\n\r]*").match
    _decode = json.JSONDecoder(object_pairs_hook=Document).raw_decode

    @staticmethod
    def decoder():  # noqa: ANN205
        return codecs.getincrementaldecoder("utf-8")().decode

    @staticmethod
    def size(text: str) -> int:
        return len(text.encode())

    @classmethod
    def space(cls, text: str, at: int) -> int:
        at = cls._space(text, at).end()
        if at >= len(text):
            raise Ends("the directory ends early")
        return at

    @classmethod
    def key(cls, text: str, at: int) -> tuple[str | None, int, int]:
        """The next key, no code and where its value begins; None after the last."""
        at = cls.space(text, at)
        if text[at] == "}":
            return None, 0, at + 1
        if text[at] != '"':
            raise Ends("the directory is no JSON")
        name, at = scanstring(text, at + 1)
        at = cls.space(text, at)
        if text[at] != ":":
            raise Ends("the directory is no JSON")
        return name, 0, cls.space(text, at + 1)

    @staticmethod
    def opened(text: str, at: int, code: int) -> int | None:
        return at + 1 if text[at] == "{" else None

    @classmethod
    def value(cls, text: str, at: int, code: int) -> tuple[object, int]:
        return cls._decode(text, at)

    @classmethod
    def after(cls, text: str, at: int) -> int:
        """Past the comma after a value."""
        at = cls.space(text, at)
        if text[at] == ",":
            at = cls.space(text, at + 1)
            if text[at] == '"':
                return at
        elif text[at] == "}":
            return at
        raise Ends("the directory is no JSON")


class BsonForm:
    """Places in bytes; length words are not trusted, terminators decide."""

    word = BSON_WORD

    @staticmethod
    def decoder():  # noqa: ANN205
        return lambda raw, last=False: raw

    size = len

    @staticmethod
    def key(data: bytes, at: int) -> tuple[str | None, int, int]:
        if at >= len(data):
            raise bson.BsonEnds("document ends early")
        code = data[at]
        if not code:
            return None, 0, at + 1
        end = data.find(0, at + 1)
        if end < 0:
            raise bson.BsonEnds("key ends early")
        return data[at + 1 : end].decode(), code, end + 1

    @staticmethod
    def opened(data: bytes, at: int, code: int) -> int | None:
        if code == bson.DOCUMENT and at + 4 > len(data):
            raise bson.BsonEnds("document ends early")
        return at + 4 if code == bson.DOCUMENT else None

    value = staticmethod(bson.value)

    @staticmethod
    def after(data: bytes, at: int) -> int:
        return at


@dataclass
class Place:
    """Between two entries of a directory: what a scan that goes on from there must know."""

    form: type
    at: int
    end: int
    ordinal: int
    stack: list[Entry]


class Scan:
    """Entries of the directory between two places of a file, whose position may change meanwhile.

    A folder comes after what it holds, because its attributes may follow its
    files; ordinals count in document order.
    """

    def __init__(self, f: BinaryIO, form: type, at: int, end: int) -> None:
        self.f, self.form, self.at, self.end = f, form, at, end
        self.taken = at  # up to here the file was read; self.data holds what begins at self.at
        self.decode = form.decoder()
        self.data = self.decode(b"")
        self.pos = 0
        self.ordinal = 0
        self.stack: list[Entry] = []  # open folders, the root first

    def begin(self) -> Scan:
        self._retry(self._top)
        return self

    @classmethod
    def resume(cls, f: BinaryIO, p: Place) -> Scan:
        out = cls(f, p.form, p.at, p.end)
        out.ordinal, out.stack = p.ordinal, [replace(e) for e in p.stack]
        return out

    def place(self) -> Place:
        return Place(self.form, self.at + self.form.size(self.data[: self.pos]), self.end, self.ordinal, [replace(e) for e in self.stack])

    def __iter__(self) -> Iterator[Entry]:
        while self.stack:
            e = self._retry(self._step)
            if e is not None:
                yield e
        if self.form is JsonForm:
            while not self.data[self.pos :].strip(" \t\n\r"):
                self.pos = len(self.data)
                if not self._grow():
                    return
            raise ArchiveError("text after the directory")

    def _retry(self, step):  # noqa: ANN001, ANN202
        while True:
            try:
                return step()
            except (Ends, bson.BsonEnds, json.JSONDecodeError):
                if not self._grow():
                    raise

    def _grow(self) -> bool:
        self.f.seek(self.taken)
        raw = self.f.read(max(0, min(max(CHUNK, len(self.data) - self.pos), self.end - self.taken)))
        if not raw:
            return False
        self.taken += len(raw)
        self.at += self.form.size(self.data[: self.pos])
        self.data = self.data[self.pos :] + self.decode(raw, self.taken >= self.end)
        self.pos = 0
        return True

    def _top(self) -> None:
        if self.form is JsonForm:
            at = self.form.space(self.data, 0)
            at = self.form.opened(self.data, at, 0)
        else:
            at = self.form.opened(self.data, 0, bson.DOCUMENT)
        root = Entry("", ordinal=-1)
        if at is None:
            raise ArchiveError("the directory must be an object with files alone")
        at, opened = self._attributes(root, at)
        if not opened:
            raise ArchiveError("the directory must be an object with files alone")
        self.pos = at
        self.stack = [root]

    def _step(self) -> Entry | None:
        """Goes past the start of a folder, a file or the end of a folder; gives the latter two."""
        form, data = self.form, self.data
        above = self.stack[-1]
        name, code, at = form.key(data, self.pos)
        if name is None:
            at, again = self._attributes(above, form.after(data, at))
            if again:
                raise ArchiveError(f"{above.path}: files twice")
            self.pos = at if len(self.stack) == 1 else form.after(data, at)
            self.stack.pop()
            return above if self.stack else None
        path = f"{above.path}/{name}" if len(self.stack) > 1 else name
        inner = form.opened(data, at, code)
        if inner is None:
            raise ArchiveError(f"{path}: an entry must be an object")
        e = Entry(path, ordinal=self.ordinal)
        at, opened = self._attributes(e, inner)
        self.pos = at if opened else form.after(data, at)
        self.ordinal += 1
        if opened:
            self.stack.append(e)
            return None
        return e

    def _attributes(self, e: Entry, at: int) -> tuple[int, bool]:
        """Sets attributes from a place on; where they end, or where the entry's files begin and True."""
        form, data = self.form, self.data
        while True:
            k, code, at = form.key(data, at)
            if k is None:
                return at, False
            if k == "files":
                inner = form.opened(data, at, code)
                if inner is None:
                    raise ArchiveError(f"{e.path}: files must be an object")
                e.is_dir = True
                return inner, True
            if e.ordinal < 0:
                raise ArchiveError("the directory must be an object with files alone")
            v, at = form.value(data, at, code)
            at = form.after(data, at)
            set_attribute(e, k, v)


def open_directory(f: BinaryIO, base_shift: int = 12) -> tuple[Scan, int]:
    """Entries to come, and where member data start: base_shift bytes after what the second word counts."""
    first = f.read(12)
    if len(first) < 12:
        raise ArchiveError("no archive: too short")
    kind, off, padded = struct.unpack("<3I", first)
    if kind == JSON_WORD:
        used = struct.unpack("<I", f.read(4))[0]
        if used < 12 or padded != (used + 4 + 3) // 4 * 4 or off != padded + 4:
            raise ArchiveError("header words disagree")
        scan = Scan(f, JsonForm, 16, 16 + used)
    elif kind == BSON_WORD:
        if off != padded:
            raise ArchiveError("header words disagree")
        scan = Scan(f, BsonForm, 12, 12 + padded)
    else:
        raise ArchiveError(f"no archive: first word is {kind}")
    return scan.begin(), base_shift + off


def read_directory(f: BinaryIO, base_shift: int = 12) -> tuple[list[Entry], int]:
    """Entries in document order, and where member data start."""
    scan, base = open_directory(f, base_shift)
    return sorted(scan, key=lambda e: e.ordinal), base


# Ranks of entries of one path, files first, so that a folder stays open until its last entry.
FILE, UNPACKED_FOLDER, FOLDER = 0, 1, 2


def rank(e: Entry) -> int:
    return FILE if not e.is_dir else UNPACKED_FOLDER if e.unpacked else FOLDER


def encoded(e: Entry, as_bson: bool) -> tuple[bytes, bytes | None]:
    """The attributes of a file before and after its offset; None after if it has no offset."""
    if as_bson:
        made = bson.dumps(attributes(e, True))
        return (made, None) if e.unpacked else (made[:26], made[34:])  # length word, size and the offset's key take 26 bytes
    made = _json(attributes(e, False)).encode()
    if e.unpacked:
        return made, None
    at = made.index(b'"offset":"') + 10
    return made[:at], made[made.index(b'"', at) :]


class DirectoryWriter:
    """Writes the document to a file that can seek, from entries in the order of path segments and rank."""

    def __init__(self, out: BinaryIO, as_bson: bool) -> None:
        self.out, self.bson, self.size = out, as_bson, 0
        self.open: dict[str, list[int]] = {}  # paths of open folders and where their length words stand; the root is ""
        self.stack: list[str] = []
        self.first = True
        self._folder("", None, False)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _key(self, name: str) -> None:
        if self.bson:
            self._put(bytes([bson.DOCUMENT]) + name.encode() + b"\0")
        else:
            self._put((("" if self.first else ",") + json.dumps(name) + ":").encode())
            self.first = False

    def _folder(self, path: str, name: str | None, unpacked: bool) -> None:
        if name is not None:
            self._key(name)
        starts = [self.size]
        if self.bson:
            self._put(bytes(4) + (bytes([bson.BOOLEAN]) + b"unpacked\0\1" if unpacked else b"") + bytes([bson.DOCUMENT]) + b"files\0")
            starts.append(self.size)
            self._put(bytes(4))
        else:
            self._put(b'{"unpacked":true,"files":{' if unpacked else b'{"files":{')
        self.first = True
        self.open[path] = starts
        self.stack.append(path)

    def _close(self) -> None:
        starts = self.open.pop(self.stack.pop())
        if self.bson:
            for start in reversed(starts):
                self._put(b"\0")
                self.out.seek(start)
                self.out.write(struct.pack("<i", self.size - start))
                self.out.seek(self.size)
        else:
            self._put(b"}}")
        self.first = False

    def _enter(self, path: str, unpacked: bool) -> None:
        """Closes what does not hold this folder and opens it, with those above it."""
        missing = []
        while path not in self.open:
            missing.append(path)
            path = path.rpartition("/")[0]
        while self.stack[-1] != path:
            self._close()
        for p in reversed(missing):
            self._folder(p, p.rpartition("/")[2], unpacked and p == missing[0])

    def add(self, path: str, kind: int, head: bytes, tail: bytes | None, offset: int) -> None:
        if kind != FILE:
            self._enter(path, kind == UNPACKED_FOLDER)
            return
        above, _, name = path.rpartition("/")
        self._enter(above, False)
        self._key(name)
        self._put(head if tail is None else head + (struct.pack("<q", offset) if self.bson else str(offset).encode()) + tail)

    def close(self) -> int:
        while self.stack:
            self._close()
        return self.size
