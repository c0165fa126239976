import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from haplodeck.llm import lm_scores as lm
from haplodeck.llm import packing, queries


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5


def counts_of(rows, order):
    """Per part: counters of the n-grams of each order, and of texts."""
    grams = {p: [Counter() for _ in range(order)] for p in range(5)}
    texts = Counter()
    for key, text in rows:
        t = tokens(text)
        texts[fold(key)] += 1
        padded = ["<s>"] * (order - 1) + t
        for i in range(len(t)):
            for k in range(order):
                grams[fold(key)][k][tuple(padded[i + order - 1 - k:i + order])] += 1
    return grams, texts


def add(grams, parts, order):
    out = [Counter() for _ in range(order)]
    for p in parts:
        for k in range(order):
            out[k].update(grams[p][k])
    return out


def plain(t, c, texts, known, order):
    """(level, bucket, estimates) of each token, from counters."""
    n = sum(c[0].values())
    padded = ["<s>"] * (order - 1) + t
    for i in range(len(t)):
        f, level, size = [1 / (known + 1), c[0][(t[i],)] / n if n else 1 / (known + 1)], 1, 1
        for k in range(1, order):
            context = tuple(padded[i + order - 1 - k:i + order - 1])
            seen = texts if set(context) == {"<s>"} else c[k - 1][context]
            if not seen:
                break
            f.append(c[k][tuple(padded[i + order - 1 - k:i + order])] / seen)
            level, size = k + 1, seen
        yield level, int(math.log2(size)), f + [0.0] * (order + 1 - len(f))


def expected(rows, order, weights):
    grams, texts = counts_of(rows, order)
    parts = [p for p in range(5) if p != lm.HELD_OUT]
    c = add(grams, parts, order)
    n, known, all_texts = sum(c[0].values()), len(c[0]), sum(texts[p] for p in parts)
    for key, text in rows:
        t = tokens(text)
        base = sum(math.log10((c[0][(w,)] + 0.5) / (n + 0.5 * (known + 1))) for w in t)
        score = sum(math.log10(float(weights.table[level, b] @ np.array(f)))
                    for level, b, f in plain(t, c, all_texts, known, order))
        yield key, fold(key) == lm.HELD_OUT, len(t), sum(c[0][(w,)] > 0 for w in t), n, base, score


def same(got, want):
    def order(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])

    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5], (a, b)
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def caught_weights(monkeypatch):
    kept, original = [], lm.learned

    def learned(*a):
        kept.append(original(*a))
        return kept[-1]

    monkeypatch.setattr(lm, "learned", learned)
    return kept


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "A a A b"), (3, "a A a B"), (None, "null id a b"), (5, "x " * 3000),
       (6, "É é ß 語 x-y"), (7, "only once"), (8, "a b c d a b c d a b"), (9, "a b c d"), (10, "a b c d"), (11, "a b")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_counters(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    kept = caught_weights(monkeypatch)
    docs = spark.createDataFrame([(k, t, "x") for k, t in ODD], "doc_id long, text string, score string").repartition(3)
    got = lm.scores(docs, order=order).collect()
    same(got, list(expected(ODD, order, kept[0])))


def test_whole_table(spark, data, monkeypatch):
    kept = caught_weights(monkeypatch)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.QUERIES["op13_lm_scores"](spark, data).collect()
    same(got, list(expected(rows, lm.ORDER, kept[0])))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_near_those_of_single_tokens(spark, data, monkeypatch):
    """Cells of half an octave against expectation-maximisation over the tokens themselves."""
    kept = caught_weights(monkeypatch)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lm.scores(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    grams, texts = counts_of(rows, 2)
    parts = [p for p in range(5) if p != lm.HELD_OUT]
    known = len(add(grams, parts, 2)[0])
    level, bucket, f, deleted = [], [], [], {}
    for key, text in rows:
        if fold(key) in parts:
            others = [p for p in parts if p != fold(key)]
            if fold(key) not in deleted:
                deleted[fold(key)] = add(grams, others, 2)
            c = deleted[fold(key)]
            for a, b, e in plain(tokens(text), c, sum(texts[p] for p in others), known, 2):
                level.append(a), bucket.append(b), f.append(e)
    exact = lm.Weights(2)
    exact.learn(np.array(level), np.array(bucket), np.ones(len(level)), np.array(f))
    assert np.abs(exact.table - kept[0].table)[2, np.unique([b for a, b in zip(level, bucket) if a == 2])].max() < 0.03


def test_probabilities_sum_to_one():
    text = "a b a c b a".split()
    weights = lm.Weights(2)
    weights.table[2, :, :3] = [0.1, 0.3, 0.6]
    c = [Counter([(w,) for w in text + [None]]), Counter(zip(text, text[1:] + [None]))]
    for context in ("a", "b", "c"):
        total = 0
        for w in ["a", "b", "c", None, "unknown"]:
            f = [1 / 5, c[0][(w,)] / 7, c[1][(context, w)] / c[0][(context,)]]
            total += weights.table[2, 0] @ np.array(f)
        assert total == pytest.approx(1)


def test_empty_table_and_no_training_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(empty).collect() == []
    held = next(i for i in range(100) if fold(i) == lm.HELD_OUT)
    got = lm.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_packing_round_trip():
    for values in ([], [0], [0, 0, 255, 256], [1 << 63, (1 << 64) - 1]):
        v = np.array(values, np.uint64)
        assert packing.unpack(packing.pack(v)).tolist() == values
        assert packing.unpack_rising(packing.pack_rising(np.sort(v))).tolist() == sorted(values)
    assert packing.stretched(packing.squeezed(b"")) == b"" and packing.stretched(packing.squeezed(b"ab")) == b"ab"
