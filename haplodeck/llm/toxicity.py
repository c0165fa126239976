"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4 and 5 bytes, so that unseen
endings of a known stem are recognised. Filters of width 1, 2 and 3 slide over the words of the whole
text; each keeps its largest response, and a logistic layer reads these. Only the text is an input.

The model is fitted on all labelled texts whose id falls outside the held-out fifth and the calibrating
fifth. It starts from a fit on START_PER_CLASS texts of each class (of at most START_CHARS characters, lowest hash
of the id first). Then every partition takes the common weights through all its texts, both classes weighted
alike, and the weights are averaged by how often a partition moved them, PASSES times. All labelled
texts of the calibrating fifth, counted by steps of their logits, set the curve of the score with natural class
shares (so 0.5 is the even chance) and a threshold per language, which goes with the score but does not
change it. Scoring runs in the tasks with the model as a broadcast of fixed size.

Null text counts as empty and gets the score of an empty text. Labels of a text that is labelled both
ways are left out. With no label of one class the score is the share of toxic labels (0.5 without
any). Repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import PUNCTUATION, chunks, starts_of_words, words

FOLDS = 5
START_PER_CLASS = 3000
START_CHARS = 20_000
PASSES = 1
BUCKETS = 1 << 15
TABLES = 3
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
RATE, PASS_RATE = 0.01, 0.002
#: Rows of an embedding table that are averaged together.
BLOCK = 4096
#: Steps per unit, and ends, by which logits are counted for calibration.
STEPS, FAR = 256, 64
#: A language needs so many toxic texts in the calibrating fifth for a threshold of its own.
LANGUAGE_LEAST = 20
_PAD = max(WIDTHS) - 1


def fold(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, first): embedding rows of every word, one line per table, each text
    followed by padding words; `first` is each text's first word in that layout."""
    for at, to, data, offsets in chunks(texts):
        w = words(data, offsets, apart=PUNCTUATION)
        hashes = (w.hashes, starts_of_words(w, 4), starts_of_words(w, 5))
        n = np.diff(w.first)
        first = np.concatenate([[0], np.cumsum(n + 1 + _PAD)])
        ids = np.full((TABLES, first[-1]), BUCKETS, np.int32)
        place = np.arange(len(w.hashes)) + np.repeat(first[:-1] - w.first[:-1], n)
        for j, h in enumerate(hashes):
            ids[j, place] = (h % np.uint64(BUCKETS)).astype(np.int32)
        yield at, to, ids, first


class Classifier:
    """Weights as plain arrays: embeddings, filters and output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Classifier:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (TABLES, BUCKETS + 1, SIZE)).astype(np.float32)
        emb[:, BUCKETS] = 0
        w = {"emb": emb, "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
             "bias": np.zeros(1, np.float32)}
        for width in WIDTHS:
            w[f"f{width}"] = rng.normal(0, 1 / np.sqrt(width * SIZE), (width, SIZE, FILTERS)).astype(np.float32)
            w[f"b{width}"] = np.zeros(FILTERS, np.float32)
        return cls(w)

    def responses(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Largest response of every filter per text, and on request the word where it is."""
        emb = self.w["emb"]
        x = emb[0][ids[0]]
        for j in range(1, TABLES):
            x = x + emb[j][ids[j]]
        best, at = [], []
        for width in WIDTHS:
            z = x @ self.w[f"f{width}"][0]
            for o in range(1, width):
                z[:-o] += x[o:] @ self.w[f"f{width}"][o]
            # a text's padding starts no window (the first padding word stands for an empty text)
            for k in range(_PAD):
                z[first[1:] - 1 - k] = -np.inf
            top = np.maximum.reduceat(z, first[:-1], axis=0)
            best.append(np.maximum(top + self.w[f"b{width}"], 0))
            if where:
                hit = z == np.repeat(top, np.diff(first), axis=0)
                spot = np.where(hit, np.arange(len(z))[:, None], len(z))
                at.append(np.minimum.reduceat(spot, first[:-1], axis=0))
        return np.concatenate(best, axis=1), at

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.responses(ids, first)[0] @ self.w["out"] + self.w["bias"][0]

    def fit(self, texts: list[tuple[np.ndarray, int]], seed: int = 7) -> None:
        """texts: (ids of one text with its padding, label)."""
        rng, steps = np.random.default_rng(seed), Steps(self, RATE)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                part = [texts[i] for i in order[a:a + BATCH]]
                ids = np.concatenate([t for t, _ in part], axis=1)
                first = np.concatenate([[0], np.cumsum([t.shape[1] for t, _ in part])])
                steps.step(ids, first, np.array([y for _, y in part], np.float32))


class Steps:
    """Adam on the touched weights of a model; `moved` counts the steps of every embedding row."""

    def __init__(self, model: Classifier, rate: float):
        self.model, self.rate, self.n = model, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.square = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.moved = np.zeros((TABLES, BUCKETS + 1), np.float32)

    def _update(self, name, grad, rows=None) -> None:
        m, s, v = self.mean[name], self.square[name], self.model.w[name]
        if rows is None:
            rows = slice(None)
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        s[rows] = 0.99 * s[rows] + 0.01 * grad * grad
        v[rows] -= self.rate * (m[rows] / (1 - 0.9 ** self.n)) / (np.sqrt(s[rows] / (1 - 0.99 ** self.n)) + 1e-6)

    def step(self, ids: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        """One step over a few texts."""
        w = self.model.w
        best, at = self.model.responses(ids, first, where=True)
        p = 1 / (1 + np.exp(-np.clip(best @ w["out"] + w["bias"][0], -80, 80)))
        self.n += 1
        delta = ((p - label) * weight / len(label)).astype(np.float32)
        back = delta[:, None] * w["out"] * (best > 0)
        self._update("out", best.T @ delta)
        self._update("bias", delta.sum(keepdims=True))
        touched, grads = [], []
        for k, width in enumerate(WIDTHS):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            f, spot = w[f"f{width}"].copy(), at[k]
            gf = np.zeros_like(f)
            for o in range(width):
                seen = ids[:, np.minimum(spot + o, ids.shape[1] - 1)]  # table, text, filter
                x = sum(w["emb"][j][seen[j]] for j in range(TABLES))
                gf[o] = np.einsum("nfs,nf->sf", x, g)
                touched.append(seen.reshape(TABLES, -1))
                grads.append((g[:, :, None] * f[o].T[None]).reshape(-1, SIZE))
            self._update(f"f{width}", gf)
            self._update(f"b{width}", g.sum(axis=0))
        seen, grad = np.concatenate(touched, axis=1), np.concatenate(grads)
        for j in range(TABLES):
            rows, back_to = np.unique(seen[j], return_inverse=True)
            total = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(total, back_to, grad)
            live = rows < BUCKETS
            self._update("emb", total[live], (j, rows[live]))
            self.moved[j, rows[live]] += 1


def _blocks(w: dict[str, np.ndarray]) -> list[tuple[str, object]]:
    """(name, place in it) of the parts of the weights that are averaged apart."""
    return [(name, ...) for name in sorted(w) if name != "emb"] + [
        ("emb", (j, slice(a, min(a + BLOCK, BUCKETS)))) for j in range(TABLES) for a in range(0, BUCKETS, BLOCK)]


def passed(rows: DataFrame, model: Classifier, weights: tuple[float, float], seed: int = 7) -> Classifier:
    """The model after one pass over all rows (`_t` text, `_y` label): every partition goes on from the same
    weights. An embedding row's change is the mean over partitions by the steps that touched it, that of other
    weights by texts. `weights`: of a text of class 0 and 1."""
    shared = rows.sparkSession.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier({k: v.copy() for k, v in shared.value.items()})
        steps, rng, n = Steps(own, PASS_RATE), np.random.default_rng(seed), 0
        share = np.array(weights, np.float32)
        for batch in batches:
            batch = batch.take(pa.array(rng.permutation(batch.num_rows)))
            label = np.asarray(batch.column(1)).astype(np.int64)
            n += len(label)
            for at, to, ids, first in features(batch.column(0)):
                for a in range(0, to - at, BATCH):
                    b = min(a + BATCH, to - at)
                    y = label[at + a:at + b]
                    steps.step(ids[:, first[a]:first[b]], first[a:b + 1] - first[a], y.astype(np.float32), share[y])
        if not n:
            return
        for i, (name, place) in enumerate(_blocks(own.w)):
            change = (own.w[name][place] - shared.value[name][place]).astype(np.float64)
            count = steps.moved[place].astype(np.float64) if name == "emb" else np.array([n], np.float64)
            if count.any():
                change = change * count[:, None] if name == "emb" else change * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([change.tobytes()], pa.binary()),
                     pa.array([count.tobytes()], pa.binary())], ["block", "change", "count"])

    def added(part: pa.Table) -> pa.Table:
        sums = [np.sum([np.frombuffer(v.as_py()) for v in sorted(part[c], key=lambda v: v.as_py())], axis=0)
                for c in ("change", "count")]
        return pa.table({"block": part["block"][:1], **{
            c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("change", "count"), sums)}})

    kind = "block int, change binary, count binary"
    got = rows.select("_t", "_y").mapInArrow(run, kind).groupBy("block").applyInArrow(added, kind).collect()
    new, blocks = {k: v.copy() for k, v in model.w.items()}, _blocks(model.w)  # as large as the model
    for r in got:
        name, place = blocks[r["block"]]
        old, count = new[name][place], np.maximum(np.frombuffer(r["count"]), 1)
        change = np.frombuffer(r["change"]).reshape(old.shape)
        new[name][place] = old + (change / (count[:, None] if name == "emb" else count[0])).astype(np.float32)
    shared.unpersist()
    return Classifier(new)


def calibrated(logit: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the logits, each met n times, by damped Newton steps."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        g = np.array([(n * (p - label) * logit).sum() + 0.01 * (slope - 1), (n * (p - label)).sum()])
        v = n * (p * (1 - p) + 1e-6)
        h = np.array([[(v * logit * logit).sum() + 0.01, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2 / (np.abs(d).max() + 1e-12))
        slope, shift = slope - d[0], shift - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return max(float(slope), 0.05), float(shift)


def best_threshold(score: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """Threshold with the highest F1 over scores met n times; the middle between it and the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, y, n = score[order], label[order], n[order]
    hits, upto = np.cumsum(y * n), np.cumsum(n)
    f1 = 2 * hits / (upto + (y * n).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut inside equal scores is none
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def _start(docs: DataFrame, known: DataFrame, key: str, text: str) -> list[tuple[np.ndarray, int]]:
    """(ids, label) of the texts that the fit starts from, chosen by ids before any text moves."""
    near = docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= START_CHARS).select(key, F.col(text).alias("_t"))
    ids = near.select(key).distinct().join(known, key).withColumn("_h", F.xxhash64(key))
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("_y") == y).orderBy("_h", key).limit(START_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = near.join(F.broadcast(chosen), key).groupBy(key, "_h").agg(  # twice START_PER_CLASS
        F.first("_y").alias("_y"), F.min(F.struct("_t")).alias("_s")).orderBy("_h", key)
    out = []
    for row in texts.toLocalIterator():
        for _, _, ids, _ in features(pa.array([row["_s"]["_t"]], pa.string())):
            out.append((ids, int(row["_y"])))
    return out


def _logit_counts(docs: DataFrame, known: DataFrame, model: Classifier, key: str, text: str, lang: str):
    """(logit, label, how many, language) lists of all labelled texts, by steps of the logit."""
    at = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("logit"))) * STEPS)
    rows = logits(docs, model, (key, lang), text).join(known, key).groupBy(
        F.col(lang).alias("_l"), "_y", at.alias("_at")).agg(F.count("*").alias("_n")).orderBy("_at", "_y", "_l").collect()
    return (np.array([(r["_at"] + 0.5) / STEPS for r in rows]), np.array([float(r["_y"]) for r in rows]),
            np.array([float(r["_n"]) for r in rows]), np.array([r["_l"] for r in rows], object))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic", lang: str = "lang"):
    """(classifier or None, slope, shift, thresholds by language)."""
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select(key, "_y")
    docs = docs.where(F.col(key).isNotNull() & (fold(key) != 0))
    learnt = docs.where(fold(key) != 1)
    # joined by the hash first, so that the texts of a partition come in no order of their ids, and always by
    # sorting, so that it is the same order whatever the size of the labels
    rows = learnt.select(key, F.col(text).alias("_t")).withColumn("_h", F.xxhash64(key)).join(
        known.withColumn("_h", F.xxhash64(key)).hint("merge"), ["_h", key]).select("_t", "_y")
    n = {r["_y"]: r["n"] for r in docs.select(key).join(known, key).groupBy((fold(key) == 1).alias("_held"), "_y").agg(
        F.count("*").alias("n")).where("not _held").collect()}
    if len(n) < 2:
        of = {r["_y"]: r["n"] for r in docs.select(key).join(known, key).groupBy("_y").agg(F.count("*").alias("n")).collect()}
        share = sum(y * m for y, m in of.items()) / sum(of.values()) if of else 0.5
        return None, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), {}
    model = Classifier.fresh()
    model.fit(_start(learnt, known, key, text))
    for _ in range(PASSES):
        model = passed(rows, model, tuple(sum(n.values()) / 2 / n[y] for y in (0, 1)))
    logit, truth, times, of = _logit_counts(docs.where(fold(key) == 1), known, model, key, text, lang)
    if len(set(truth)) < 2:
        logit, truth, times, of = _logit_counts(docs, known, model, key, text, lang)
    slope, shift = calibrated(logit, truth, times)
    score = 1 / (1 + np.exp(-(slope * logit + shift)))
    limits = {}
    for language in sorted({x for x in of if x is not None}):
        own = of == language
        if (truth * times)[own].sum() >= LANGUAGE_LEAST:
            limits[language] = best_threshold(score[own], truth[own], times[own])
    return model, slope, shift, limits


def logits(docs: DataFrame, model: Classifier | None, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The kept columns and the uncalibrated logit of every whole text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model.w if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value) if shared.value else None
        for batch in batches:
            logit = np.zeros(batch.num_rows)
            if own:
                for at, to, ids, first in features(batch.column(len(keep))):
                    logit[at:to] = own.logits(ids, first)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(logit, pa.float64())], [*keep, "logit"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{schema}, logit double")


def scores(docs: DataFrame, model: Classifier | None, slope: float, shift: float, keep: tuple[str, ...],
           text: str = "text") -> DataFrame:
    """The kept columns and score of every whole text."""
    return logits(docs, model, keep, text).select(
        *keep, (1 / (1 + F.exp(-(F.col("logit") * slope + shift)))).alias("score"))


def held_out_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    label: str = "toxic", lang: str = "lang") -> DataFrame:
    """key, held_out, score, predicted, threshold (of the row's language, else 0.5), flagged."""
    model, slope, shift, limits = train(docs, labels, key, text, label, lang)
    out = scores(docs, model, slope, shift, (key, lang), text)
    own = F.lit(0.5)
    for language, limit in limits.items():  # languages with enough calibration texts: a few dozen
        own = F.when(F.col(lang) == language, limit).otherwise(own)
    return out.select(
        key, (fold(key) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        own.alias("threshold"), (F.col("score") >= own).alias("flagged"))
