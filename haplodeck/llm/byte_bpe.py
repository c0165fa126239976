"""Byte-level BPE by recursive DuckDB queries, one embedded database per Python worker.

Each batch of a partition is cut into the pattern's words. A word the worker has not met becomes one row:
its tokens and, for every two neighbours, the token they merge to. A recursive query contracts the
leftmost pair of lowest rank of every word and joins the two new pairs beside it with the merge table,
until no word has a pair left. Decoding joins the ids with the vocabulary, in order. A text's ids are its
words' ids one after the other.

Words of like length share a query, and it holds fewer the longer they are. A word over LONG_WORD bytes
would need one recursion step per merge; such words are merged by an equivalent priority queue instead,
which gives the same ids.

Null text counts as empty; empty text has no ids and decodes to nothing. Repeated rows and ties give
repeated results; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.workers import once_per_worker, pattern_words

LONG_WORD = 200
#: Words per recursive query, and words a worker remembers; the older half is forgotten at a time,
#: but for those met again meanwhile.
WORDS_PER_QUERY = 25_000
#: Words of a query times the square of the longest one's bytes.
SQUARES_PER_QUERY = 4_000_000
CACHED_WORDS = 240_000

#: Stands for a pair of neighbours that has no merge.
NO_PAIR = 2**31 - 1

ENCODE = f"""
WITH RECURSIVE step(word, tokens, pairs) AS (
    SELECT word, tokens, pairs FROM letters
    UNION ALL
    (WITH low AS (SELECT word, tokens, pairs, list_min(pairs) AS merged FROM step),
    best AS (
        SELECT word, tokens, pairs, merged, list_position(pairs, merged) AS p
        FROM low WHERE merged < {NO_PAIR})
    SELECT word, list_concat(tokens[:p - 1], [merged], tokens[p + 2:]),
           list_concat(pairs[:greatest(p - 2, 0)],
                       CASE WHEN p > 1 THEN [coalesce(l.made, {NO_PAIR})] ELSE [] END,
                       CASE WHEN p < len(pairs) THEN [coalesce(r.made, {NO_PAIR})] ELSE [] END,
                       pairs[p + 2:])
    FROM best
    LEFT JOIN merges l ON l.pair = CASE WHEN p > 1 THEN tokens[p - 1]::BIGINT << 32 | merged END
    LEFT JOIN merges r ON r.pair = merged::BIGINT << 32 | tokens[p + 2])
)
SELECT word, tokens FROM step WHERE coalesce(list_min(pairs), {NO_PAIR}) = {NO_PAIR}
"""

DECODE = """
SELECT i.word, i.token, v.bytes
FROM (SELECT word, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM ids) i
JOIN vocabulary v ON v.id = i.token ORDER BY i.word, i.pos
"""


class RecursiveCoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = pattern_words()
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.letter = np.array(self.single, np.int32)
        self.letter_pairs = np.full(1 << 16, NO_PAIR, np.int32)
        ranks, pairs, made = self.ranks, array("q"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
            if len(token) == 2:
                self.letter_pairs[token[0] << 8 | token[1]] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB"})
        self._store("merges", {"pair": pa.array(np.array(pairs)), "made": pa.array(np.array(made))})
        self._store("vocabulary", {
            "id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})

    def _store(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("_rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _queue(self, data: bytes) -> list[int]:
        """Leftmost lowest pair first, as the recursion does, for one long word."""
        n, ranks, tokens = len(data), self.ranks, self.tokens
        token = [self.single[b] for b in data]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n

        def pair(i: int):
            j = after[i]
            return None if j < 0 else ranks.get(tokens[token[i]] + tokens[token[j]])

        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != rank:
                continue
            j = after[i]
            token[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def learn(self, words: list[str], raw: list[bytes]) -> None:
        """Adds ids and decoded bytes of new words, given with their bytes, to what is known."""
        sizes = np.array([len(r) for r in raw])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        pairs = self.letter_pairs[data[:-1] << 8 | data[1:]]
        inside = np.ones(len(pairs), bool)
        inside[ends[1:-1] - 1] = False  # no pair across two words
        self._store("letters", {
            "word": pa.array(np.arange(len(raw), dtype=np.int32)),
            "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.letter[data])),
            "pairs": pa.ListArray.from_arrays(
                pa.array(ends - np.arange(len(ends)), pa.int32()), pa.array(pairs[inside]))})
        self.db.execute(f"CREATE OR REPLACE TABLE ids AS {ENCODE}")
        rows = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        self.db.execute("DROP TABLE ids; DROP TABLE letters")
        first = np.searchsorted(rows["word"].to_numpy(), np.arange(len(raw) + 1))
        ids, (_, where, text) = rows["token"].to_numpy().astype("<i4").tobytes(), rows["bytes"].chunk(0).buffers()
        at, text = np.frombuffer(where, np.int32)[first].tolist(), text.to_pybytes()
        first = (first * 4).tolist()
        self.known.update(
            (w, (ids[first[i]:first[i + 1]], text[at[i]:at[i + 1]])) for i, w in enumerate(words))

    def _learn_all(self, words: list[str]) -> None:
        """Long words by the queue, the others in queries of words of like length: each needs as many
        rounds as its longest word, and holds as many bytes as its words' lengths squared."""
        short, raw = [], [w.encode() for w in words]
        for i, r in enumerate(raw):
            if len(r) > LONG_WORD:
                merged = self._queue(r)
                self.known[words[i]] = (b"".join(t.to_bytes(4, "little") for t in merged),
                                        b"".join(self.tokens[t] for t in merged))
            else:
                short.append(i)
        sizes = np.array([len(raw[i]) for i in short])
        order = np.array(short, np.int64)[np.argsort(sizes, kind="stable")].tolist()
        at = 0
        while at < len(order):
            to = min(at + WORDS_PER_QUERY, len(order))
            while to > at + 1 and (to - at) * len(raw[order[to - 1]]) ** 2 > SQUARES_PER_QUERY:
                to = at + (to - at + 1) // 2
            self.learn([words[i] for i in order[at:to]], [raw[i] for i in order[at:to]])
            at = to

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(little-endian 32-bit ids, decoded bytes) of every text."""
        seen: dict[str, str] = {}  # one object per different word of the block, however often it occurs
        cut = [list(map(seen.setdefault, words, words)) for words in map(self.pattern, texts)]
        if len(self.known) >= CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in seen:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        if new:
            self._learn_all(new)
        out = []
        for words in cut:
            ids, data = zip(*map(known.__getitem__, words), strict=True) if words else ((), ())
            out.append((b"".join(ids), b"".join(data)))
        return out


def coder(path: str) -> RecursiveCoder:
    return once_per_worker(("recursive coder", path), lambda: RecursiveCoder(path))


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 2_000_000):
    """Rows in blocks of about `most` bytes of text: few recursive queries, bounded memory."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= most:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _ids_column(packed: list[bytes]) -> pa.Array:
    """Packed ids of each text as a list column, without an object per id."""
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _coded(docs: DataFrame, path: str | None, key: str, text: str, columns: dict, make) -> DataFrame:
    file = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def typed(source):
            nonlocal key_type
            for batch in source:
                key_type = batch.schema.field(0).type
                yield batch

        for keys, texts in _blocks(typed(batches)):
            values = [make(ids, data) for ids, data in coder(file).encode(texts)]
            made = [_ids_column([v[i] for v in values]) if pa.types.is_list(t) else pa.array(
                [v[i] for v in values], t) for i, (_, t) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *made], [key, *columns])

    schema = ", ".join([f"{key} {kind}", *[f"{c} {t}" for c, (t, _) in columns.items()]])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """key, ids (array of token ids), decoded (text read back from the ids)."""
    return _coded(docs, path, key, text,
                  {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())},
                  lambda ids, data: (ids, data.decode()))


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256."""
    return _coded(docs, path, key, text,
                  {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
                   "decoded_sha256": ("string", pa.string())},
                  lambda ids, data: (len(ids) // 4, sha256(ids).hexdigest(), sha256(data).hexdigest()))


def tokenised(docs: DataFrame, path: str | None = None, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """key, n_tokens, ids, decoded_sha256: what a trainer reads, and a check of the way back."""
    return _coded(docs, path, key, text,
                  {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())),
                   "decoded_sha256": ("string", pa.string())},
                  lambda ids, data: (len(ids) // 4, ids, sha256(data).hexdigest()))
