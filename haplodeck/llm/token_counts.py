"""Token counts by prefix dynamic programming.

The count of every prefix of a text is computed once, so that "how many tokens are in the first k
characters" and "how much of the text fits into n tokens" need no further encoding.

For one word of the pre-tokenizer the table is filled from left to right: the last token of prefix
i is the one vocabulary entry ending at i that stays apart from the last token of the prefix in
front of it (encoding the two together gives the two again). So count[i] = count[i - len] + 1.
Words restart the encoder, so a text's table is the words' tables on top of running totals. Where a
cut changes the words themselves (inside a run of blanks, inside a contraction, inside the special
string) the table has the count of the cut text.

Null text counts as empty. Empty text has an empty table and no tokens. Repeated rows and ties give
repeated results; columns besides the key are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.workers import once_per_worker, pattern_words

#: Cached words per worker, in two halves of which the older is dropped. Longer words are not cached.
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in byte order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Prefix tables of one byte-level vocabulary; built once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in set(self.specials)}
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}  # a token's merge
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        self.words = pattern_words()
        self.blank = regex.compile(r"\s+")
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.whole: dict[bytes, bool] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.two_blanks = re.compile(r"\s\s")  # at least the blanks of the pattern's engine
        self.tables: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, for strings of one or two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p) for p in zip(parts, parts[1:], strict=False)]
            found = [r for r in ranks if r is not None]
            if not found:
                break
            i = ranks.index(min(found))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _keeps_apart(self, left: bytes, right: bytes) -> bool:
        """Whether two whole tokens side by side encode as themselves. Going back in time, the later of
        the two tokens' merges is undone; the pair that met then must not have merged before it. Of
        equal ranks the one further left goes first."""
        rank, made, limit = self.rank, self.made, len(self.rank)
        while True:
            met = rank.get((left, right))
            if met is not None and met < limit:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def _stays(self, before: bytes, token: bytes) -> bool:
        if not before:
            if token not in self.whole:
                self.whole[token] = len(self.merge(token)) == 1
            return self.whole[token]
        key = (before, token)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 1_000_000:
                self.apart.clear()
            known = self.apart[key] = self._stays(b"", token) and self._keeps_apart(before, token)
        return known

    def _fill(self, data: bytes) -> list[int]:
        """Token count of every byte prefix, the empty one included. From each end it goes back as long as
        some entry ends in what was passed, so only entries that end here are tried, the longest first."""
        counts, last = [0] * (len(data) + 1), [0] * (len(data) + 1)
        vocab, tails, stays = self.vocab, self.tails, self._stays
        for end in range(1, len(data) + 1):
            start = end - 1
            while start >= 0 and data[start:end] in tails:
                start -= 1
            for start in range(start + 1, end):
                token = data[start:end]
                if token in vocab and stays(data[start - last[start]:start], token):
                    last[end], counts[end] = end - start, counts[start] + 1
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return counts

    def table(self, word: str) -> bytes:
        """Counts of the word's prefixes by characters, as 32-bit integers in a byte string."""
        found = self.tables.get(word)
        if found is not None:
            return found
        found = self.older.get(word)
        packed = self._packed(word) if found is None else found
        if len(word) <= CACHED_LENGTH:
            if len(self.tables) >= CACHED_WORDS // 2:
                self.older, self.tables = self.tables, {}  # words in use come back from the older half
            self.tables[word] = packed
        return packed

    def _packed(self, word: str) -> bytes:
        counts = self._fill(word.encode())
        if word in _CONTRACTIONS:
            ends = [1, 2, counts[-1]]  # cut after two characters, it is no contraction
        elif len(counts) == len(word) + 1:
            ends = counts[1:]
        else:
            at, ends = 0, []
            for c in word:
                at += len(c.encode())
                ends.append(counts[at])
        return np.asarray(ends, np.uint32).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        words = self.words(text)
        table = self.table
        packed = [self.tables.get(w) or table(w) for w in words]
        inner = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        totals = inner[ends - 1]
        starts = np.cumsum(totals) - totals
        counts = inner + np.repeat(starts, sizes)
        for i, w in enumerate(words[:-1] if self.two_blanks.search(text) else ()):
            # a blank run lends its last character to what follows; cut right there, it is one word
            if w[0].isspace() and self.blank.match(words[i + 1]) and self.blank.fullmatch(w):
                run = np.frombuffer(self.table(w + words[i + 1][0]), np.uint32)
                counts[ends[i]] = starts[i] + int(run[-1])
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Token count of every non-empty prefix of the text, by characters."""
        if not text:
            return np.zeros(0, np.int64)
        hits = list(self.special.finditer(text)) if self.special else []
        if not hits:
            return self._plain(text)
        out, base, at = [], 0, 0
        for hit in hits:
            # until its last character the special string is ordinary text behind the segment
            part = self._plain(text[at:hit.end()])
            inside = hit.start() - at
            total = (int(part[inside - 1]) if inside else 0) + 1
            part[-1] = total
            out.append(part + base)
            base, at = base + total, hit.end()
        if at < len(text):
            out.append(self._plain(text[at:]) + base)
        return np.concatenate(out)


def counter(path: str) -> PrefixCounter:
    return once_per_worker(("prefix counter", path), lambda: PrefixCounter(path))


def _by_batch(docs: DataFrame, key: str, text: str, answer, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield from answer(part.column(0), (t or "" for t in part.column(1).to_pylist()))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def prefix_table(docs: DataFrame, path: str | None = None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """key, prefix_counts: entry k - 1 is the exact token count of the first k characters."""
    file = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType.simpleString()

    def answer(keys, texts):
        own = counter(file)
        tables = [own.counts(t).astype(np.int32) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(tables, pa.list_(pa.int32()))], [key, "prefix_counts"])

    return _by_batch(docs, key, text, answer, f"{key} {kind}, prefix_counts array<int>")


def tokens_in(table: DataFrame, characters) -> DataFrame:
    """tokens: count of the first `characters` characters (a column or number), from the table."""
    n = F.least(F.lit(characters) if isinstance(characters, int) else characters,
                F.size("prefix_counts"))
    return table.withColumn(
        "tokens", F.when(n > 0, F.element_at("prefix_counts", F.greatest(n, F.lit(1)))).otherwise(0))


def fitting(table: DataFrame, budget: int) -> DataFrame:
    """fits: characters of the longest prefix of at most `budget` tokens, from the table. A longer
    prefix may need fewer tokens, so the last position counts, not the first one beyond."""
    at = F.transform("prefix_counts", lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return table.withColumn("fits", F.coalesce(F.array_max(at), F.lit(0)))


def token_counts(docs: DataFrame, limit: int = 1024, path: str | None = None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, fits (characters of the longest prefix within `limit`
    tokens). Each text's prefix table is built in its task and answers all of them; only the
    answers leave it."""
    file = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType.simpleString()

    def answer(keys, texts):
        own, rows = counter(file), []
        for t in texts:
            table = own.counts(t)
            n = int(table[-1]) if len(table) else 0
            fits = len(table) if n <= limit else int(np.flatnonzero(table <= limit)[-1]) + 1
            rows.append((len(t.encode()), n, n > limit, fits))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
            [key, "n_bytes", "n_tokens", "over_limit", "fits"])

    return _by_batch(docs, key, text, answer,
                     f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, fits long")
