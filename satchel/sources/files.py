"""spark.read.format("filetree"): files and folders as members, in pre-order by name.

Symbolic links are followed, names that begin with a point are members like
others, and what is neither file nor folder is an error. A stored path begins
with the last component of the root. Excluded folders (option exclude, patterns
one a line) are not entered. Each child of the root is walked by its own task.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from satchel.operators.patterns import Pattern, glob_regex

SCHEMA = "path string, is_dir boolean, size bigint, executable boolean, modified timestamp, content binary"


@dataclass
class Branch(InputPartition):
    file: str
    path: str
    walk: bool


def excluder(lines: str):
    """A predicate of (path, name) for patterns, one a line."""
    tests = []
    for t in filter(None, lines.split("\n")):
        kind, text = Pattern(t).rule()
        tests.append((kind, text if kind == "equals" else re.compile(glob_regex(text).replace("\\z", "\\Z").replace("(?s)\\A", "\\A"), re.S)))
    return lambda path, name: any(path == t if k == "equals" else bool(t.match(path if k == "path" else name)) for k, t in tests)


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://")
        self.content = str(options.get("content", "false")).lower() == "true"
        self.exclude = options.get("exclude", "")

    def partitions(self) -> list[Branch]:
        name = self.root.rsplit("/", 1)[-1]
        out = [Branch(self.root, name, False)]
        if os.path.isdir(self.root):
            out += [Branch(f"{self.root.rstrip('/')}/{n}", f"{name}/{n}" if name else n, True) for n in sorted(os.listdir(self.root))]
        return out

    def read(self, part: Branch) -> Iterator[tuple]:
        skip = excluder(self.exclude)
        root_name = self.root.rsplit("/", 1)[-1]
        if root_name and skip(root_name, root_name) or not part.path:
            return
        stack = [(part.file, part.path)]
        while stack:
            file, path = stack.pop()
            if skip(path, path.rsplit("/", 1)[-1]):
                continue
            s = os.stat(file)
            folder = stat.S_ISDIR(s.st_mode)
            if not folder and not stat.S_ISREG(s.st_mode):
                raise ValueError(f"neither file nor folder: {file}")
            data = None
            if self.content and not folder:
                with open(file, "rb") as f:
                    data = f.read()
            yield path, folder, None if folder else s.st_size, bool(s.st_mode & 0o111) and not folder, datetime.fromtimestamp(s.st_mtime, timezone.utc), data
            if folder and part.walk:
                stack += [(f"{file}/{n}", f"{path}/{n}") for n in sorted(os.listdir(file), reverse=True)]


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:  # noqa: ANN001
        return FileTreeReader(dict(self.options))


def read_files(spark: SparkSession, root: str, content: bool = False, exclude: list[str] | None = None) -> DataFrame:
    from satchel.sources.archive import register

    register(spark)
    return spark.read.format("filetree").options(content=str(content).lower(), exclude="\n".join(exclude or [])).load(root)
