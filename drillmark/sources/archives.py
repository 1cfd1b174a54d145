"""Decode the tar archive of each row."""

from __future__ import annotations

import io
import json
import tarfile
import tomllib

import pandas as pd
from pyspark.sql import DataFrame

from drillmark.schemas import MAX_ARCHIVE_MEMBER_BYTES
from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)

# The members of a task archive.
INSTRUCTION, METADATA, TESTS = "instruction.md", "task.toml", "tests/test_data.json"

DECODED = (
    "instruction string, difficulty string, tags array<string>, tests string, error string"
)


_MEMBERS = ["instruction", "difficulty", "tags", "tests", "error"]


def _member(archive: tarfile.TarFile, name: str) -> bytes:
    info = archive.getmember(name)
    if not info.isfile() or info.size > MAX_ARCHIVE_MEMBER_BYTES:
        raise ValueError(f"{name} is not a regular file of at most {MAX_ARCHIVE_MEMBER_BYTES} bytes")
    return archive.extractfile(info).read()


def _decode(blob: bytes) -> dict:
    try:
        with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as archive:
            metadata = tomllib.loads(_member(archive, METADATA).decode("utf-8"))["metadata"]
            return {
                "instruction": _member(archive, INSTRUCTION).decode("utf-8"),
                "difficulty": str(metadata.get("difficulty", "medium")),
                "tags": [str(t) for t in metadata.get("tags") or ()],
                "tests": json.dumps(json.loads(_member(archive, TESTS)), ensure_ascii=False),
                "error": None,
            }
    except Exception as exc:  # a broken archive is a rejected row, not a failed job
        return dict.fromkeys(("instruction", "difficulty", "tags", "tests")) | {
            "error": f"{type(exc).__name__}: {exc}"
        }


# Rows decoded at a time: the members of a row may hold megabytes each.
_ROWS = 100


def decode_archives(df: DataFrame, blob: str = "task_binary") -> DataFrame:
    """Replace the blob column by the decoded members, or an ``error``.

    Spark bounds the bytes of an incoming batch
    (``spark.sql.execution.arrow.maxBytesPerBatch``); the unpacked texts go back
    in small frames.
    """
    kept = [c for c in df.columns if c != blob]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != blob)

    def batches(frames):
        for frame in frames:
            for start in range(0, len(frame), _ROWS):
                part = frame.iloc[start : start + _ROWS]
                decoded = pd.DataFrame(
                    [_decode(b or b"") for b in part[blob]], columns=_MEMBERS, index=part.index
                )
                yield pd.concat([part[kept], decoded], axis=1)

    return df.mapInPandas(batches, f"{schema}, {DECODED}")
