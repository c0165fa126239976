"""Integer columns as small byte strings, and texts in blocks: what counting operators shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from haplodeck.llm.arrow_text import words

#: Text of a block and its rows at most; a longer single text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 20_000
#: Text whose words are cut at a time.
CUT_BYTES = 1 << 20
_ZSTD = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, as many as the largest needs: plain planes compress."""
    if not len(values):
        return b"\0"
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    """Sorted non-negative integers by their steps."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, _ZSTD, asbytes=True)


def stretched(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, _ZSTD, asbytes=True) if size else b""


def text_volume(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, a few more for every row."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    return docs.agg(F.sum(size + 8)).first()[0] or 0


class Block(NamedTuple):
    name: str  # holds a checksum of the texts
    group: object
    keys: list
    offsets: np.ndarray
    body: bytes


def _grouped(rows: DataFrame, then: Callable[[Block], pa.RecordBatch], schema: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(g) -> pa.RecordBatch:
            nonlocal made
            keys, texts, _ = held.pop(g)
            made += 1
            body = b"".join(texts)
            offsets = np.cumsum([0] + [len(t) for t in texts])
            return then(Block(f"{task}-{made}-{zlib.crc32(body):08x}", g, keys, offsets, body))

        for batch in batches:
            groups, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            for i, g in enumerate(groups):
                t = texts[i].as_py()
                own = held.setdefault(g, [[], [], 0])
                own[0].append(keys[i])
                own[1].append(t)
                own[2] += len(t)
                if own[2] >= BLOCK_BYTES or len(own[0]) >= BLOCK_ROWS:
                    yield block(g)
        for g in list(held):
            yield block(g)

    return rows.mapInArrow(cut, schema)


def _rows(docs: DataFrame, key: str, text: str, group: Column) -> DataFrame:
    return docs.select(group.alias("group"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_blocks(docs: DataFrame, key: str, text: str, group: Column, then: Callable[[Block], pa.RecordBatch],
               schema: str) -> DataFrame:
    """What `then` makes of every block; the same blocks as `blocks` returns."""
    return _grouped(_rows(docs, key, text, group), then, schema)


def blocks(docs: DataFrame, key: str, text: str, group: Column) -> DataFrame:
    """block, group, keys array, offsets binary, body binary: the texts of a partition, those of
    one group together, in blocks of bounded size. The name of a block holds a checksum of its texts, so
    a block that comes out otherwise in a second attempt meets nothing instead of the wrong rows; `docs`
    should be a stored table, which reads alike every time."""
    rows = _rows(docs, key, text, group)
    kinds = to_arrow_schema(rows.schema)
    group_type, key_type = kinds.field("group").type, kinds.field("key").type

    def packed(b: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([b.name]), pa.array([b.group], group_type), pa.array([b.keys], pa.list_(key_type)),
            pa.array([squeezed(pack_rising(b.offsets.astype(np.uint64)))], pa.binary()),
            pa.array([squeezed(b.body)], pa.binary())], ["block", "group", "keys", "offsets", "body"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("group", "key")}
    return _grouped(rows, packed, f"block string, group {kind['group']}, keys array<{kind['key']}>, "
                                  "offsets binary, body binary")


def block_texts(offsets: bytes, body: bytes) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of a block's texts."""
    return unpack_rising(stretched(offsets)).astype(np.int64), stretched(body)


def block_words(offsets: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the total), cut a few texts at a time."""
    data, found, sizes, at = np.frombuffer(body, np.uint8), [], [], 0
    while at + 1 < len(offsets):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CUT_BYTES, "right")) - 1)
        w = words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        found.append(w.hashes)
        sizes.append(np.diff(w.first))
        at = to
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[dict]]]:
    """(values, rows) of every run of equal values in a partition sorted by those columns."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[c] for c in columns)
            if rows and own != now:
                yield now, rows
                rows = []
            now = own
            rows.append(row)
    if rows:
        yield now, rows
