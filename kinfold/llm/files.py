"""Files that executors write and read by byte range, at any URI pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data) -> int:
    """Write bytes, or what an iterator of bytes yields, under a name of its own, then move it into place:
    a task that is lost or runs twice leaves either nothing or the whole file. Returns the length."""
    store, path = at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for piece in [data] if isinstance(data, (bytes, bytearray)) else data:
            out.write(piece)
            n += len(piece)
    store.move(part, path)
    return n
