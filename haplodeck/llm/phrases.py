"""Phrase collocations: phrases of two to four words that are far more frequent than their parts suggest.

Suffixes (the up to four words from a position to the end of its piece) are routed to tasks by language
and their two leading words, so a task holds all suffixes of its word pairs. There, pointers to the
suffixes are sorted by multikey three-way quicksort: a range is parted by a pivot at the present word into
less, equal and greater; the size of an equal part is the count of the phrase up to that word, and the
equal part goes on at the next word, down to the fourth. A part with fewer suffixes than a candidate
needs is abandoned, whatever it holds.

Equal suffixes of a block of text are sent once with their number. A word pair, or three words, that
begins more than a thousandth of all suffixes (at most 1,024 of each; found by counts of those frequent in a block)
is routed by one word more; the counts of its parts are added up afterwards. Words travel as 64-bit hashes;
single words are counted as text and give the phrases back their letters at the end. Candidates and their parts
meet in joins with salted keys; arithmetic is on decimals.

Null text counts as empty, null language as `und`. Repeated rows count as often as they occur. Ties
end in the phrase's bytes, which are unique within a language. Pieces of any length are cut no further. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import CHUNK_BYTES, chunks, mixed, words
from haplodeck.llm.packing import pack, pack_rising, runs, text_volume, unpack, unpack_rising
from haplodeck.llm.tables import written

LEAST, LONGEST, TOP, INSIDE_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000
BLOCK_BYTES, BUCKET_BYTES, SALTS = 4 << 20, 8 << 20, 8
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A prefix is told if it begins 1/TOLD of a block's suffixes, and hot if 1/HOT of all.
_TOLD, _HOT = 2048, 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffixes(data: np.ndarray, offsets: np.ndarray):
    """(words, their suffixes): row i holds the hashes of the words from word i to the end of its piece, at
    most four, and zeros behind them."""
    w = words(data, offsets, apart=b".,;:!?")
    ends = np.zeros(256, np.int64)
    ends[list(_PIECE_ENDS)] = 1
    piece = np.concatenate([[0], np.cumsum(ends[data])])[w.starts]
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    n = len(w.hashes)
    out = np.zeros((n, LONGEST), np.uint64)
    own = np.maximum(w.hashes, np.uint64(1))
    out[:, 0] = own
    same = np.ones(n, bool)
    for k in range(1, LONGEST):
        near = np.zeros(n, bool)
        m = max(n - k, 0)
        near[:m] = (piece[k:] == piece[:m]) & (text[k:] == text[:m])
        same &= near
        out[:m, k][same[:m]] = own[k:][same[:m]]
    return w, own, out


def prefix_keys(lang: str, suffix: np.ndarray) -> list[np.ndarray]:
    """Keys of the first one, two, ... words of every suffix, in that language."""
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    keys = [mixed(suffix[:, 0] ^ seed)]
    for k in range(1, LONGEST):
        keys.append(mixed(keys[-1] * _STEP + suffix[:, k]))
    return keys


def _texts(batches: Iterator[pa.RecordBatch]):
    """(language, bytes, offsets) of blocks of texts of one language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(code == i)))
            for _, _, data, offsets in chunks(texts, BLOCK_BYTES):
                yield lang, data, offsets


def _cut(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of a few texts of a block at a time, as words take many times the bytes of their text."""
    at = 0
    while at + 1 < len(offsets):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each in the parts set end to end, sum of its counts)."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], np.add.reduceat(n[order], first) if len(key) else n


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(starts), [
        None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def _counts(rows: DataFrame) -> DataFrame:
    """lang, depth, word, key, n. Depth 0: words with their hashes; depth 2 and 3: frequent prefixes."""
    names = ["lang", "depth", "word", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, offsets in _texts(batches):
            total, spelt, found = 0, [], {d: ([], []) for d in (0, 2, 3)}
            for some in _cut(data, offsets):
                w, own, suffix = suffixes(*some)
                total += len(own)
                key, at, n = np.unique(own, return_index=True, return_counts=True)
                spelt.append(_strings(w.data, w.starts[at], w.ends[at]))
                found[0][0].append(key)
                found[0][1].append(n)
                keys = prefix_keys(lang, suffix)
                for depth in (2, 3):
                    key, n = np.unique(keys[depth - 1][suffix[:, depth - 1] > 0], return_counts=True)
                    found[depth][0].append(key)
                    found[depth][1].append(n)
            if not total:
                continue
            key, at, n = _summed(*found.pop(0))
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(key), pa.string()), pa.array(np.zeros(len(key), np.int32)),
                pa.concat_arrays(spelt).take(pa.array(at)), pa.array(key.view(np.int64)), pa.array(n)], names)
            for depth in (2, 3):
                key, _, n = _summed(*found.pop(depth))
                told = n * _TOLD >= total
                key, n = key[told], n[told]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), depth, np.int32)),
                    pa.nulls(len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names)

    return rows.mapInArrow(run, "lang string, depth int, word string, key long, n long").groupBy(
        *names[:4]).agg(F.sum("n").alias("n"))


def _route(keys: list[np.ndarray], hot: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key that decides the task, how many leading words it covers)."""
    key, depth = keys[1].copy(), np.full(len(keys[1]), 2)
    for d in (2, 3):
        deeper = (depth == d) & np.isin(keys[d - 1], hot[d])
        key[deeper], depth[deeper] = keys[d][deeper], d + 1
    return key, depth


def distinct_suffixes(lang: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct suffixes of two words or more in a block, how often each stands there)."""
    parts, keys, counts = [np.zeros((0, LONGEST), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for some in _cut(data, offsets):
        _, _, suffix = suffixes(*some)
        suffix = suffix[suffix[:, 1] > 0]
        key, at, n = np.unique(prefix_keys(lang, suffix)[-1], return_index=True, return_counts=True)
        parts.append(suffix[at])
        keys.append(key)
        counts.append(n)
    _, at, n = _summed(keys, counts)
    return np.concatenate(parts)[at], n


def _routed(rows: DataFrame, hot: dict[int, np.ndarray], buckets: int) -> DataFrame:
    names = ["bucket", "lang", "words", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, offsets in _texts(batches):
            suffix, n = distinct_suffixes(lang, data, offsets)
            if not len(suffix):
                continue
            bucket = (_route(prefix_keys(lang, suffix), hot)[0] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((*(suffix[:, k] for k in reversed(range(LONGEST))), bucket))
            suffix, n, bucket = suffix[order], n[order], bucket[order]
            found = np.unique(bucket)
            edge = np.append(np.searchsorted(bucket, found), len(bucket))
            known, ids, counts = [], [], []
            for a, b in zip(edge[:-1], edge[1:]):
                vocabulary, where = np.unique(suffix[a:b], return_inverse=True)
                where = where.reshape(-1, LONGEST).astype(np.uint64)
                known.append(pack_rising(vocabulary))
                ids.append([pack_rising(where[:, 0]), *[pack(where[:, k]) for k in range(1, LONGEST)]])
                counts.append(pack(n[a:b]))
            yield pa.RecordBatch.from_arrays([
                pa.array(found, pa.int32()), pa.array([lang] * len(found)), pa.array(known, pa.binary()),
                pa.array(ids, pa.list_(pa.binary())), pa.array(counts, pa.binary())], names)

    return rows.mapInArrow(run, "bucket int, lang string, words binary, ids array<binary>, counts binary")


def equal_parts(suffix: np.ndarray, n: np.ndarray, least: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
    """(words, row with that prefix, suffixes that begin so) by multikey three-way quicksort; suffix row i
    stands n[i] times. A part of fewer than least[d] suffixes is abandoned at word d."""
    stack = [(np.arange(len(n)), 0)]
    while stack:
        at, d = stack.pop()
        if not len(at) or n[at].sum() < least[d]:
            continue
        v = suffix[at, d]
        pivot = np.sort(v[[0, len(v) // 2, -1]])[1]
        equal = at[v == pivot]
        if len(equal) < len(at):
            stack.append((at[v < pivot], d))
            stack.append((at[v > pivot], d))
        total = int(n[equal].sum())
        if pivot and total >= least[d]:
            yield d + 1, int(equal[0]), total
            if d + 1 < suffix.shape[1]:
                stack.append((equal, d + 1))


def _sorted_counts(routed: DataFrame, hot: dict[int, np.ndarray], least: int) -> DataFrame:
    names = ["lang", "depth", "w0", "w1", "w2", "w3", "n"]
    # of a hot prefix this task may hold a small share only, so its parts are kept up to the routed word
    bars = {2: (least,) * 4, 3: (1, 1, least, least), 4: (1, 1, 1, least)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), rows in runs(batches, "bucket", "lang"):
            parts, counts = {c: [] for c in bars}, {c: [] for c in bars}
            for r in rows:
                known = unpack_rising(r["words"])
                ids = [unpack_rising(r["ids"][0]), *[unpack(c) for c in r["ids"][1:]]]
                suffix = known[np.stack(ids, 1).astype(np.int64)]
                n = unpack(r["counts"]).astype(np.int64)
                depth = _route(prefix_keys(lang, suffix), hot)[1]
                for covered in np.unique(depth).tolist():
                    own = depth == covered
                    parts[covered].append(suffix[own])
                    counts[covered].append(n[own])
            out: list[tuple[int, np.ndarray, int]] = []
            for covered, bar in bars.items():
                if not parts[covered]:
                    continue
                mine, n = np.concatenate(parts.pop(covered)), np.concatenate(counts.pop(covered))
                # copies, as a row of `mine` would keep all of it
                out += [(d, mine[i].copy(), total) for d, i, total in equal_parts(mine, n, bar) if d > 1]
            if not out:
                continue
            d = np.array([o[0] for o in out])
            w = np.stack([o[1] for o in out])
            w[np.arange(LONGEST) >= d[:, None]] = 0
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(d)), pa.array(d, pa.int32()),
                *[pa.array(w[:, k].copy().view(np.int64)) for k in range(LONGEST)],
                pa.array([o[2] for o in out], pa.int64())], names)

    return routed.mapInArrow(
        run, "lang string, depth int, w0 long, w1 long, w2 long, w3 long, n long")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST):
    """(vocabulary: lang, word, key, n of every word; phrases: lang, ws, a of all phrases of two to four
    words with at least `least` occurrences), both written. `ws` holds the words' keys."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(_counts(rows), "phrase-words")
    vocabulary = counts.where("depth = 0").drop("depth")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    hot = {d: np.zeros(0, np.uint64) for d in (2, 3)}
    for r in counts.where(F.col("depth") > 0).where(F.col("n") * _HOT >= total).select("depth", "key").collect():
        hot[r["depth"]] = np.append(hot[r["depth"]], np.uint64(r["key"] % (1 << 64)))  # 1,024 a depth at most
    buckets = max(1, -(-text_volume(docs, text) // BUCKET_BYTES))
    routed = _routed(rows, hot, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang")
    ws = F.slice(F.array("w0", "w1", "w2", "w3"), 1, F.col("depth"))
    found = _sorted_counts(routed, hot, least).groupBy("lang", "depth", "w0", "w1", "w2", "w3").agg(
        F.sum("n").alias("a")).where(F.col("a") >= least)
    return vocabulary, written(found.select("lang", ws.alias("ws"), "a"), "phrases")


def _with_counts(rows: DataFrame, known: DataFrame, part: str, name: str, spread: Column) -> DataFrame:
    """Adds the count of the words in `part`; keys are salted, as one word may lead most phrases."""
    salted = known.select(F.col("lang"), F.col("ws").alias(part), F.col("n").alias(name),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(
        salted, ["lang", part, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of every language."""
    vocabulary, phrases = frequent_phrases(docs, text, lang, least)
    size = F.size("ws")
    pieces = F.expr("flatten(transform(sequence(2, size(ws) - 1), k -> "
                    "transform(sequence(1, size(ws) - k + 1), i -> slice(ws, i, k))))")
    around = phrases.where(size > 2).select("lang", "a", F.explode(pieces).alias("ws")).groupBy("lang", "ws").agg(
        F.max("a").alias("longer"))
    kept = phrases.join(around, ["lang", "ws"], "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * INSIDE_PERCENT, F.lit(True))).drop("longer")
    known = phrases.select("lang", "ws", F.col("a").alias("n")).unionByName(
        vocabulary.where(F.col("n") >= least).select("lang", F.array("key").alias("ws"), "n"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({
        "left": F.slice("ws", F.lit(1), F.col("k")), "right": F.slice("ws", F.col("k") + 1, size)})
    cuts = _with_counts(_with_counts(cuts, known, "left", "l", F.col("right")), known, "right", "r", F.col("left"))
    score = F.expr(f"cast(cast({SCALE} as decimal(19, 0)) * cast(a as decimal(19, 0)) div (l + r) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "ws", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("_low")).select(
        "lang", "ws", "a", "_low.l", "_low.r", "_low.score")
    # letters are looked up for those phrases only that can be among the first
    falling = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = scored.withColumn("_place", F.rank().over(falling)).where(F.col("_place") <= top).drop("_place")
    spelt = first.select("lang", "ws", F.posexplode("ws").alias("_i", "key")).withColumn(
        "_salt", F.pmod(F.hash("ws"), F.lit(SALTS))).join(
        vocabulary.where(F.col("n") >= least).select("lang", "key", "word", F.explode(
            F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), ["lang", "key", "_salt"]).groupBy("lang", "ws").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(_i, word))), x -> x.word)"), " ").alias("phrase"))
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = first.join(spelt, ["lang", "ws"]).withColumn("rank", F.row_number().over(
        falling.orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))).cast("long"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
