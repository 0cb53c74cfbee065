"""Single files in a folder that driver and executors share: texts written by tasks, and streams written by the driver."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut


@contextlib.contextmanager
def created(uri: str):
    """A file that is there as a whole or not at all: a local path, or any store that Arrow reaches."""
    if re.match(r"[a-z][a-z0-9+.-]*:", uri) and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as f:
            yield f
        return
    path = re.sub(r"^file:/*", "/", uri)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        yield f
    os.replace(part, path)


def texts(df: DataFrame, folder: str) -> DataFrame:
    """Write a file for each row (path, content) of df, by tasks; the manifest (path, bytes, sha256), each once written.

    Paths must differ. A task that runs again writes the same file again.
    """

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (content or "").encode("utf-8", "surrogatepass")
                with created(f"{folder}/{path}") as f:
                    f.write(raw)
                out.append((path, len(raw), hashlib.sha256(raw).hexdigest()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    return cut(df.select("path", "content").mapInArrow(run, "path string, bytes long, sha256 string"))


def stream(pieces: Iterable[str | bytes], path: str) -> None:
    """Write pieces of text to one file as they come: nothing but the present one is held."""
    with created(path) as f:
        for p in pieces:
            f.write(p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass"))


def lines(df: DataFrame, order: list[str], folder: str) -> Iterable[bytes]:
    """The one text column of df, a line each, in order: written by tasks to folder, and its files' bytes one after the other."""
    df.orderBy(*order).drop(*order).write.mode("overwrite").text(folder)
    if re.match(r"[a-z][a-z0-9+.-]*:", folder) and not folder.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        names, opened = [x.path for x in store.get_file_info(fs.FileSelector(path))], store.open_input_stream
    else:
        path = re.sub(r"^file:/*", "/", folder)
        names, opened = [f"{path}/{x}" for x in os.listdir(path)], lambda x: open(x, "rb")
    # Spark names them by partition.
    for name in sorted(x for x in names if os.path.basename(x).startswith("part-")):
        with opened(name) as f:
            while piece := f.read(1 << 22):
                yield piece


def json_rows(df: DataFrame, order: list[str], drop: list[str] | None = None) -> Iterable[str]:
    """The rows of df as JSON objects, in order, a partition at a time."""
    kept = [c for c in df.columns if c not in (drop or [])]
    rows = df.orderBy(*order).select(F.to_json(F.struct(*kept)).alias("j"))
    return (r[0] for r in rows.toLocalIterator())


def joined(rows: Iterable[str], begin: str, end: str) -> Iterable[str]:
    yield begin
    for i, r in enumerate(rows):
        yield r if i == 0 else "," + r
    yield end
