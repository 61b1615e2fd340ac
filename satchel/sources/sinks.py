"""Extraction to files, and the C form of an archive."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.paths import safe
from satchel.operators.integrity import verify
from satchel.operators.manifest import compressed, long_line, packed, running_before
from satchel.schema import BLOCK
from satchel.session import shared_dir

#: The lines around the data.
START, END = "/* start of in-memory archive */", "/* end of in-memory archive */"


def extract(members: DataFrame, destination: str, keep_existing: bool = False, check: bool = False, block: int = BLOCK) -> DataFrame:
    """Writes packed files below destination, on executors; returns path, bytes, action, line (as in a long
    listing), a row for each, from a table in the shared folder.

    destination must be a folder that all executors share. Empty folders are
    not made. Absolute paths and those with '..' are refused, and so are paths
    with a tilde. With check a file whose hash, block hashes or size are not as
    stated is not written, its action is 'damaged'. A file appears under its
    name when it is complete; bytes go out a block at a time.
    """
    rows = packed(members)
    bad = rows.where(~safe(F.col("path")) | F.contains("path", F.lit("~"))).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"path not allowed: {bad[0].path}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for path, data, sound, line in zip(p.path, p.content, p.sound, p.line, strict=True):
                target = os.path.join(destination, path)
                if not sound:
                    out.append((path, 0, "damaged", line))
                    continue
                if keep_existing and os.path.isfile(target):
                    out.append((path, 0, "kept", line))
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part, view = f"{target}.part-{os.getpid()}", memoryview(data or b"")
                with open(part, "wb") as f:
                    for i in range(0, len(view), BLOCK):
                        f.write(view[i : i + BLOCK])
                os.replace(part, target)
                out.append((path, len(view), "written", line))
            yield pd.DataFrame(out, columns=["path", "bytes", "action", "line"])

    sound = F.lit(True)
    if check:
        rows = verify(rows, block=block)
        sized = F.octet_length("content") == F.coalesce("compression.original_size", "size")
        sound = F.coalesce(F.col("hash_ok"), F.lit(True)) & F.coalesce(F.col("bad_blocks") == 0, F.lit(True)) & F.coalesce(sized, F.lit(True))
    line = long_line() if {"integrity", "compression", "executable"} <= set(rows.columns) else F.col("path")
    done = rows.select("path", "content", sound.alias("sound"), line.alias("line")).mapInPandas(run, "path string, bytes long, action string, line string")
    report = f"{shared_dir(members.sparkSession)}/satchel-{uuid.uuid4().hex}"
    done.write.parquet(report)  # once: reading the report again writes no files
    return members.sparkSession.read.schema(done.schema).parquet(report)


def prune_empty(folder: str) -> int:
    """Removes empty folders below folder, from the deepest up, and returns how many. Runs on the driver."""
    n = 0
    for at, _, _ in os.walk(folder, topdown=False):
        if at != folder and not os.listdir(at):
            os.rmdir(at)
            n += 1
    return n


def contents(members: DataFrame) -> Iterator[bytes]:
    """Bytes of packed files in document order, one at a time."""
    for r in packed(members).orderBy("archive_path", "ordinal").select("content").toLocalIterator():
        yield bytes(r.content or b"")


def c_literal(data: bytes) -> str:
    """Octal escapes, a new line after byte 32, 64 and so on."""
    out = ['  "']
    for i, b in enumerate(data):
        out.append(f"\\{b:o}")
        if i and i % 32 == 0:
            out.append('"\n  "')
    return "".join([*out, '";'])


def write_dump(members: DataFrame, path: str) -> None:
    """Packed files (path, size, content, compression, ordinal) as C text between marker lines; in an existing file
    only what stands between them is replaced, or added at its end. Members go by one at a time."""
    base = os.path.splitext(os.path.basename(path))[0]
    numbered = running_before(packed(members), F.lit(1), "ordinal", "idx").select("path", "size", "content", "idx", F.when(compressed(), 1).otherwise(0).alias("alg"), F.coalesce("compression.original_size", F.lit(0)).alias("original"))
    before, after = split_dump(open(path).read().splitlines(keepends=True)) if os.path.exists(path) else ([], [])
    part = f"{path}.part"
    with open(part, "w") as out:
        out.writelines(before)
        if before and not before[-1].endswith("\n"):
            out.write("\n")
        out.write(f"{START}\n\n")
        for r in numbered.orderBy("idx").toLocalIterator():
            out.write(f"/* {r.path} */\nstatic unsigned char file_{base}_{r.idx}[{r.size}] =\n{c_literal(bytes(r.content or b''))}\n\n")
        rows = numbered.drop("content").orderBy("path")
        out.write(f"/* {base} directory (sorted by path) */\nstruct memdir directory_{base}[{rows.count()}] = {{\n")
        for r in rows.toLocalIterator():
            out.write(f'  {{ "{r.path}", {r.size}, {r.alg}, {r.original}, &file_{base}_{r.idx}[0] }},\n')
        out.write(f"}};\n\n{END}\n")
        out.writelines(after)
    os.replace(part, path)


def split_dump(lines: list[str]) -> tuple[list[str], list[str]]:
    """What stands before the start line and after the end line."""
    bare = [x.rstrip("\r\n") for x in lines]
    if START not in bare:
        return lines, []
    i = bare.index(START)
    rest = bare[i:]
    return lines[:i], lines[i + rest.index(END) + 1 :] if END in rest else []
