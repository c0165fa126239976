"""Log-probabilities of texts under an n-gram model with deleted interpolation.

Counting. Texts are cut into blocks. A block asks for its distinct n-grams of all orders; a question goes
to the task that owns the n-gram's hash, once a block with the block's own count, so a word pair that
holds a third of all tokens is one row a block. The owner adds the counts up and answers every block, in
the order asked, with the count in all training texts and the count in the block's own part. Nothing of
the model, which grows with the corpus, is broadcast or collected.

Estimation. The training texts are four parts by the remainder of their id's checksum. In the text of a
part, every n-gram is predicted from the counts of the other parts ("deleted"), whose maximum-likelihood
estimates of each order are mixed with the uniform distribution. The weights of the mixture belong to a
bucket: the longest context seen, and the power of two its frequency reaches. Expectation-maximisation on
these held-out counts sets them. For that, tokens are summed in cells of like estimates (half an
octave wide, with the cell's mean), a table of bounded size. Scores use the full counts. Over the known words,
the end and one unknown word, the probabilities after any context sum to one.

Null text counts as empty: its end is its only token. Null ids form the fold of an empty id. Repeated
rows count as often as they occur and get equal scores. Without training texts all probabilities
are one. Other columns are not looked at. The default order is 2 (see README for the figures);
`order` takes 1 to 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import mixed
from haplodeck.llm.packing import (
    Block,
    block_texts,
    block_words,
    blocks,
    map_blocks,
    pack,
    pack_rising,
    runs,
    squeezed,
    stretched,
    text_volume,
    unpack,
    unpack_rising,
)
from haplodeck.llm.tables import written

FOLDS, HELD_OUT, ORDER = 5, 1, 2
#: Bytes of text a bucket of n-grams, and a partition of blocks, stands for.
BUCKET_BYTES, PART_BYTES = 8 << 20, 16 << 20
_BEGIN, _END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_ROUNDS, _SETTLED = 300, 1e-7
_STEPS = 2  # cells per octave


def token_keys(hashes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first token of each text and the total, keys of the n-grams of order 1, 2, ... that end at each
    token). The last token of a text is its end; before its first one stand begin marks."""
    n = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)
    token = np.full(first[-1], _END, np.uint64)
    token[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
    gram, keys = mixed(token), []
    for k in range(order):
        if k:
            before = np.concatenate([[_BEGIN], gram[:-1]]).astype(np.uint64)
            before[first[:-1]] = _BEGIN
            gram = mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(token + np.uint64(k)))
        # words keep 62 bits, longer n-grams 54: they are most of what is shuffled
        keys.append((gram if k == 0 else gram >> np.uint64(8)) & ~np.uint64(3) | np.uint64(k))
    return first, keys


def _shares(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts rising keys by bucket, where each bucket starts)."""
    own = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(buckets + 1))


def _asks(docs: DataFrame, key: str, text: str, part: Column, order: int, buckets: int) -> DataFrame:
    def ask(b: Block) -> pa.RecordBatch:
        asked, counts = np.unique(np.concatenate(token_keys(*block_words(b.offsets, b.body), order)[1]), return_counts=True)
        at, edge = _shares(asked, buckets)
        found = np.flatnonzero(np.diff(edge))
        own = [at[edge[i]:edge[i + 1]] for i in found]
        return pa.RecordBatch.from_arrays([
            pa.array(found, pa.int32()), pa.array([b.name] * len(own)), pa.array([b.group] * len(own), pa.int32()),
            pa.array([squeezed(pack_rising(asked[i] // np.uint64(buckets))) for i in own], pa.binary()),
            pa.array([squeezed(pack(counts[i])) for i in own], pa.binary())], ["bucket", "block", "part", "asked", "counts"])

    return map_blocks(docs, key, text, part, ask, "bucket int, block string, part int, asked binary, counts binary")


def _answers(asks: DataFrame, buckets: int, held_out: int) -> DataFrame:
    """block, bucket, total and own counts in the order asked; known: words of the bucket, told once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in runs(batches, "bucket"):
            keys = [unpack_rising(stretched(r["asked"])) for r in rows]
            edge = np.cumsum([0] + [len(k) for k in keys])
            seen, at = np.unique(np.concatenate(keys), return_inverse=True)
            by_part: dict[int, np.ndarray] = {}
            for i, r in enumerate(rows):
                if r["part"] != held_out:
                    own = by_part.setdefault(r["part"], np.zeros(len(seen), np.int64))
                    own[at[edge[i]:edge[i + 1]]] += unpack(stretched(r["counts"])).astype(np.int64)
            total = sum(by_part.values(), np.zeros(len(seen), np.int64))
            word = (seen * np.uint64(buckets) + np.uint64(bucket)) & np.uint64(3) == 0
            known = int((word & (total > 0)).sum())
            for i, r in enumerate(rows):
                mine = at[edge[i]:edge[i + 1]]
                own = by_part[r["part"]][mine] if r["part"] != held_out else mine[:0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["block"]]), pa.array([bucket], pa.int32()), pa.array([squeezed(pack(total[mine]))], pa.binary()),
                    pa.array([squeezed(pack(own))], pa.binary()), pa.array([known if i == 0 else 0], pa.int64()),
                ], ["block", "bucket", "total", "own", "known"])

    return asks.mapInArrow(run, "block string, bucket int, total binary, own binary, known long")


def counted(docs: DataFrame, key: str, text: str, order: int = ORDER) -> DataFrame:
    """A row per block, written: part, keys, first (of each text), and for each order the counts of the
    n-gram at every token, `total` in all training texts, `own` in the block's part (none if held out)."""
    volume = text_volume(docs, text)
    buckets, spread = max(1, -(-volume // BUCKET_BYTES)), max(1, -(-volume // PART_BYTES))
    part = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    parts = blocks(docs, key, text, part)  # the texts are read twice and shuffled once
    kind = docs.schema[key].dataType.simpleString()
    told = _answers(_asks(docs, key, text, part, order, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket"),
                    buckets, HELD_OUT)
    told = told.groupBy("block").agg(
        F.sum("known").alias("known"), F.collect_list(F.struct("bucket", "total", "own")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["block", "group", "offsets", "body", "known", "told"]).to_pylist()):
                first, keys = token_keys(*block_words(*block_texts(row["offsets"], row["body"])), order)
                asked, at = np.unique(np.concatenate(keys), return_inverse=True)
                by, edge = _shares(asked, buckets)
                total, own = np.zeros(len(asked), np.uint64), np.zeros(len(asked), np.uint64)
                seen = 0
                for a in row["told"]:
                    mine = by[edge[a["bucket"]]:edge[a["bucket"] + 1]]
                    told = unpack(stretched(a["total"]))
                    seen += len(told)
                    total[mine] = told if len(told) == len(mine) else 0
                    if row["group"] != HELD_OUT and len(told) == len(mine):
                        own[mine] = unpack(stretched(a["own"]))
                if seen != len(asked):
                    raise ValueError(f"block {row['block']} has other texts than when it asked")
                n = len(keys[0])
                split = [at[j * n:(j + 1) * n] for j in range(order)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["group"]], pa.int32()), batch.column("keys").slice(i, 1),
                    pa.array([squeezed(pack_rising(first.astype(np.uint64)))], pa.binary()),
                    pa.array([[squeezed(pack(total[s])) for s in split]], pa.list_(pa.binary())),
                    pa.array([[squeezed(pack(own[s])) for s in split] if row["group"] != HELD_OUT else []],
                             pa.list_(pa.binary())),
                    pa.array([row["known"]], pa.int64()), pa.array([n], pa.int64()),
                ], ["part", "keys", "first", "total", "own", "known", "n"])

    joined = parts.repartition(spread, "block").join(told, "block").select("block", "group", "keys", "offsets", "body", "known", "told")
    return written(joined.mapInArrow(
        run, f"part int, keys array<{kind}>, first binary, total array<binary>, own array<binary>, known long, n long"),
        "ngram-counts")


def estimates(counts: list[np.ndarray], first: np.ndarray, tokens: int, texts: int, known: int):
    """(level, bucket, f): per token the longest context seen (1: none), the power of two of its
    frequency, and the columns uniform, word, pair, ... of maximum-likelihood estimates, 0 beyond the level."""
    n, order = len(counts[0]), len(counts)
    f = np.zeros((n, order + 1))
    f[:, 0] = 1 / (known + 1)
    f[:, 1] = counts[0] / tokens if tokens else f[:, 0]
    level, context = np.ones(n, np.int64), np.ones(n)
    for k in range(1, order):
        seen = np.concatenate([[0], counts[k - 1][:-1]]).astype(float)
        seen[first[:-1]] = texts
        live = seen > 0
        f[live, k + 1] = counts[k][live] / seen[live]
        level[live], context[live] = k + 1, seen[live]
    return level, np.log2(context).astype(np.int64), f


class Weights:
    """Mixture weights by level and bucket."""

    def __init__(self, order: int):
        self.table = np.zeros((order + 2, 64, order + 1))
        for level in range(1, order + 2):
            self.table[level, :, :level + 1] = 1 / (min(level, order) + 1)

    def learn(self, level: np.ndarray, bucket: np.ndarray, n: np.ndarray, f: np.ndarray) -> None:
        """Expectation-maximisation over cells of n tokens with estimates f; one pseudo-token each
        component, so that no weight is zero. A bucket without tokens takes the next lower one's
        weights, else the next higher one's."""
        for l in range(1, self.table.shape[2]):
            seen = np.unique(bucket[level == l])
            for b in seen:
                own = (level == l) & (bucket == b)
                x, c = f[own][:, :l + 1], n[own]
                w = np.full(l + 1, 1 / (l + 1))
                for _ in range(_ROUNDS):
                    share = x * w
                    share *= (c / share.sum(1))[:, None]
                    new = (share.sum(0) + 1) / (c.sum() + l + 1)
                    settled = np.abs(new - w).max() < _SETTLED
                    w = new
                    if settled:
                        break
                self.table[l, b, :l + 1] = w
            for b in range(64):
                if len(seen) and b not in seen:
                    near = seen[seen < b][-1] if (seen < b).any() else seen[0]
                    self.table[l, b] = self.table[l, near]

    def mixed(self, level: np.ndarray, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        return (self.table[level, bucket] * f).sum(1)


def _columns(row: dict, name: str) -> list[np.ndarray]:
    return [unpack(stretched(c)).astype(np.int64) for c in row[name]]


def learned(table: DataFrame, order: int, tokens: dict[int, int], texts: dict[int, int], known: int) -> Weights:
    all_tokens, all_texts = sum(tokens.values()), sum(texts.values())
    names = ["cell", "n", *[f"s{j}" for j in range(order + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = unpack_rising(stretched(row["first"])).astype(np.int64)
                deleted = [t - o for t, o in zip(_columns(row, "total"), _columns(row, "own"))]
                level, bucket, f = estimates(deleted, first, all_tokens - tokens[row["part"]],
                                             all_texts - texts[row["part"]], known)
                cell = level * 64 + bucket
                for j in range(1, order + 1):
                    with np.errstate(divide="ignore"):
                        step = np.where(f[:, j] > 0, 1 + np.floor(-_STEPS * np.log2(f[:, j])), 0)
                    cell = cell * 256 + step.astype(np.int64)
                cells, at = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), pa.array(np.bincount(at), pa.int64()),
                     *[pa.array(np.bincount(at, f[:, j])) for j in range(order + 1)]], names)

    schema = "cell long, n long, " + ", ".join(f"{c} double" for c in names[2:])
    cells = table.where(F.col("part") != HELD_OUT).mapInArrow(run, schema).groupBy("cell").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names[2:]]).toArrow()  # bounded: levels, buckets, octaves
    out = Weights(order)
    if cells.num_rows:
        n = cells["n"].to_numpy().astype(float)
        group = cells["cell"].to_numpy() // 256 ** order
        out.learn(group // 64, group % 64, n, np.stack([cells[c].to_numpy() for c in names[2:]], 1) / n[:, None])
    return out


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    kind = docs.schema[key].dataType.simpleString()
    table = counted(docs, key, text, order)
    sums = {r["part"]: r for r in table.groupBy("part").agg(
        F.sum("n").alias("n"), F.sum(F.size("keys")).alias("texts"), F.sum("known").alias("known")).collect()}
    known = sum(r["known"] for r in sums.values())
    tokens = {p: r["n"] for p, r in sums.items() if p != HELD_OUT}
    texts = {p: r["texts"] for p, r in sums.items() if p != HELD_OUT}
    weights = learned(table, order, tokens, texts, known)
    total, total_texts = sum(tokens.values()), sum(texts.values())
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["part", "first", "total"]).to_pylist()):
                first = unpack_rising(stretched(row["first"])).astype(np.int64)
                counts = _columns(row, "total")
                base = np.log10((counts[0] + 0.5) / (total + 0.5 * (known + 1)))
                own = np.log10(weights.mixed(*estimates(counts, first, total, total_texts, known)))
                at, m = first[:-1], len(first) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("keys").slice(i, 1).flatten(), pa.array([row["part"] == HELD_OUT] * m),
                    pa.array(np.diff(first)), pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), at)),
                    pa.array(np.full(m, total, np.int64)), pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(own, at))], names)

    return table.select("part", "keys", "first", "total").mapInArrow(
        run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
