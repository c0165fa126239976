"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds. Every run of GRAM words of a test item is a seed, however common it is, so every text with GRAM
intact words of an item in a row is aligned with it. A copy without such a run is not looked at.

Candidates. A text joins an item where it has one of its seeds; the seeds' diagonals (place in the
text less place in the item) give the stretches of text to align: nearby ones form one, and a stretch
reaches an item's length plus MARGIN beyond both ends.

Words are compared in lower case and without ASCII punctuation.

Score. Word-level local alignment with MATCH, MISMATCH and GAP; the score is divided by that of the
whole item. A stretch at or over `threshold` is a leak. Reordered, edited and partly replaced copies
lose in proportion to what changed.

The items are handled in blocks of at most BLOCK_WORDS words; a block's seeds and words go to every
task (their size is bounded by the block), and each block costs one pass over the texts, without a
shuffle of texts. Seeds that meet many items are taken up by whole texts, some _PAIRS pairs at a time.

Null text or item is empty: it matches nothing. Items with less than GRAM words are taken whole as one
run. Repeated items each give a row, repeated rows each their rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import PUNCTUATION, Words, chunks, grams, words
from haplodeck.llm.tables import free_name, written

GRAM = 3
WINDOW = 4
MARGIN = 12
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
#: Cells of one batch of alignments.
_CELLS = 4_000_000
#: Pairs of a seed in a text and an item that has it, held at a time; a text with more is taken alone.
_PAIRS = 2_000_000
_BITS = 22


class Block(NamedTuple):
    """Items of one block as arrays; small enough for every task."""

    numbers: np.ndarray  # row number of each item within the block
    first: np.ndarray  # first word of each item
    words: np.ndarray  # word hashes, one item after the other
    gram: np.ndarray  # hash of each run, ordered
    item: np.ndarray  # its item
    place: np.ndarray  # its place in the item


def _item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and first words of all texts."""
    found, first = [np.zeros(0, np.uint64)], [0]
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        w = words(data, offsets, apart=PUNCTUATION)
        found.append(w.hashes)
        first += (w.first[1:] + first[-1] - w.first[0]).tolist()
    return np.concatenate(found), np.array(first)


def _runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, place) of all runs; an item shorter than a run is one run of what it has."""
    gram, item, place = [], [], []
    for i in range(len(first) - 1):
        own = hashes[first[i]:first[i + 1]]
        if not len(own):
            continue
        k = min(GRAM, len(own))
        got, at = grams(Words(own, np.array([0, len(own)]), own, own, own), k)
        gram.append(got)
        item.append(np.full(len(got), i))
        place.append(at)
    if not gram:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(gram), np.concatenate(item), np.concatenate(place)


def _filter(hashes: np.ndarray) -> np.ndarray:
    """Bitmap over the hashes' top bits: most runs of a text fail it at once."""
    bits = np.zeros(1 << _BITS, bool)
    bits[hashes >> np.uint64(64 - _BITS)] = True
    return bits


def _lengths(numbers) -> list[int]:
    """Run lengths that occur among items: GRAM, and less for shorter items."""
    return sorted({min(GRAM, int(n)) for n in numbers if n})


def _hits(w: Words, lengths: list[int], bits: np.ndarray, known: np.ndarray):
    """(index into known, place) for the runs of a chunk that are among the sorted known ones."""
    for k in lengths:
        gram, place = grams(w, k)
        near = np.flatnonzero(bits[gram >> np.uint64(64 - _BITS)])
        at = np.searchsorted(known, gram[near])
        at[at == len(known)] = 0
        same = known[at] == gram[near]
        yield at[same], place[near[same]]


def rarest(counts: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Marks the rarest run (first of equals) of every WINDOW consecutive runs of an item. Seeds are not
    chosen by it: a run with count 0, or a rare one that an edit broke, would displace those of a copy."""
    chosen = np.zeros(len(counts), bool)
    bounds = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = counts[a:b]
        width = min(WINDOW, b - a)
        at = np.lib.stride_tricks.sliding_window_view(own, width).argmin(axis=1)
        chosen[a + np.unique(at + np.arange(len(at)))] = True
    return chosen


def alignment_scores(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word-hash arrays: (score, end in right). All pairs of a
    call advance together, one word of `left` at a time; gaps along `right` are a running maximum."""
    n, rows, cols = len(left), max(map(len, left)), max(map(len, right))
    a = np.zeros((n, rows), np.uint64)
    b = np.ones((n, cols), np.uint64)
    live_a, live_b = np.zeros((n, rows), bool), np.zeros((n, cols), bool)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, :len(x)], live_a[i, :len(x)] = x, True
        b[i, :len(y)], live_b[i, :len(y)] = y, True
    slope = (-GAP * np.arange(cols + 1)).astype(np.int32)
    above = np.zeros((n, cols + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(rows):
        same = (b == a[:, r:r + 1]) & live_b & live_a[:, r:r + 1]
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        now[:, 1:][~live_b] = 0
        now[~live_a[:, r]] = 0
        top = now.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], now[better].argmax(axis=1)
        above = now
    return best, end


def _stretches(doc: np.ndarray, item: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray):
    """(doc, item, from, to) in words: hits of one text and item whose reach overlaps are one stretch.
    Arrays are one entry per hit: its text, item, place in the text, the item's start on its diagonal,
    and the item's length."""
    order = np.lexsort((start, item, doc))
    doc, item, low = doc[order], item[order], start[order] - MARGIN
    high = start[order] + length[order] + MARGIN
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(fresh)
    return doc[first], item[first], low[first], np.maximum.reduceat(high, first) if len(first) else high


def _portions(doc: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts, hits ordered by text, with about _PAIRS pairs each."""
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
    sums, a = np.cumsum(many), 0
    while a < len(doc):
        most = (sums[a - 1] if a else 0) + _PAIRS
        i = int(np.searchsorted(sums[ends - 1], most, "right"))  # texts that end within the portion
        b = int(ends[i - 1]) if i and ends[i - 1] > a else int(ends[np.searchsorted(ends, a, "right")])
        yield a, b
        a = b


def _aligned(docs: DataFrame, key: str, text: str, block: Block, lengths: list[int],
             threshold: float, number: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block(*shared.value)
        known, begin = np.unique(own.gram, return_index=True)
        begin = np.append(begin, len(own.gram))
        bits, sizes = _filter(known), np.diff(own.first)
        for batch in batches:
            for base, _, data, offsets in chunks(batch.column(1)):
                w = words(data, offsets, apart=PUNCTUATION)
                at, where = [np.concatenate(x) for x in zip(*_hits(w, lengths, bits, known), strict=True)]
                if not len(at):
                    continue
                order = np.argsort(where, kind="stable")
                at, where = at[order], where[order]
                doc = np.searchsorted(w.first, where, "right") - 1
                many = begin[at + 1] - begin[at]  # items that have the seed
                for a, b in _portions(doc, many):
                    yield from scored(batch, base, w, own, sizes,
                                      *met(own, begin, sizes, w, at[a:b], where[a:b], doc[a:b], many[a:b]))

    def met(own, begin, sizes, w, at, where, doc, many):
        flat = np.repeat(begin[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, where = own.item[flat], np.repeat(where, many)
        doc, which, low, high = _stretches(
            np.repeat(doc, many), item, where, where - own.place[flat], sizes[item])
        return doc, which, np.maximum(low, w.first[doc]), np.minimum(high, w.first[doc + 1])

    def scored(batch, base, w, own, sizes, doc, which, low, high):
        cost = np.cumsum(sizes[which] * (high - low))
        at = 0
        while at < len(doc):
            to = max(int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _CELLS, "right")), at + 1)
            own_words = [own.words[own.first[i]:own.first[i + 1]] for i in which[at:to]]
            found = [w.hashes[a:b] for a, b in zip(low[at:to], high[at:to], strict=True)]
            score, end = alignment_scores(own_words, found)
            part = score / (MATCH * sizes[which[at:to]])
            leak = np.flatnonzero(part >= threshold)
            if len(leak):
                rows = at + leak
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(base + doc[rows])), pa.array(own.numbers[which[rows]]),
                     pa.array(part[leak]), pa.array(low[rows] - w.first[doc[rows]] + end[leak])],
                    [key, number, "score", "end_word"])
            at = to

    return docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"{key} {kind}, {number} long, score double, end_word long")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, item key, score (1: the whole item), end_word (word of the text behind the aligned part),
    one row per leaked stretch."""
    listed = written(items.select(
        F.col(item_key), F.col(item_text).alias("_t"),
        F.size(F.regexp_extract_all(F.coalesce(F.col(item_text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
               ).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row")).where("_n > 0"), "items")
    total = listed.agg(F.sum("_n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_words))
    out = None
    for b in range(n_blocks):
        mine = listed.where(F.pmod(F.xxhash64("_row"), F.lit(n_blocks)) == b) if n_blocks > 1 else listed
        rows = mine.select("_row", "_t").collect()  # a block of items: bounded by block_words
        hashes, first = _item_words([r._t for r in rows])
        if not len(hashes):
            continue
        gram, item, place = _runs(hashes, first)
        order = np.argsort(gram, kind="stable")
        block = Block(np.array([r._row for r in rows]), first, hashes, gram[order], item[order], place[order])
        found = _aligned(docs, key, text, block, _lengths(np.diff(first)), threshold, "_row")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = {c: docs.schema[c].dataType.simpleString() for c in (key,)}
        return docs.sparkSession.createDataFrame(
            [], f"{key} {kinds[key]}, {item_key} {items.schema[item_key].dataType.simpleString()}, "
                "score double, end_word long")
    return written(out, "leaks").join(listed.select("_row", item_key), "_row").select(
        key, item_key, "score", "end_word")


def best_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document and item: best score, its end_word (first of equals), and n_stretches."""
    found = leaks(docs, items, **options)
    key, item = found.columns[:2]
    return found.groupBy(key, item).agg(
        F.max("score").alias("score"), F.max_by("end_word", F.struct("score", -F.col("end_word"))).alias("end_word"),
        F.count("*").alias("n_stretches"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    **options) -> DataFrame:
    """The documents without a leak, all columns. A row goes by its own text, whatever its `key`: one with
    a null key goes if it leaks, and a clean one stays if it shares its key with one that does."""
    mark = free_name(docs, "_leak_hash")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    dirty = written(leaks(marked, items, mark, text, **options).select(mark).distinct(), "leaking")
    few = dirty.limit(2_000_001).count() <= 2_000_000
    return marked.join(F.broadcast(dirty) if few else dirty, mark, "left_anti").drop(mark)
