import random

import numpy as np
import pyarrow as pa

from haplodeck.llm import arrow_text, jaccard_join
from haplodeck.llm.components import component_labels


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component_id) per row position."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[root(i)] = min(low.get(root(i), key), key)
    return [(len(sets[i]), None if k is None else k if not sets[i] else low[root(i)]) for i, (k, _) in enumerate(rows)]


def rows_of(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustn") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, passage = [], " ".join(rng.choice(words) for _ in range(30))

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10 ** 6))
        return w

    for base in (text(60), text(120), text(400)):
        rows += [" ".join(edited(base, rng.randint(0, max(1, len(base) // 40)))) for _ in range(60)]
    rows += [" ".join(text(40)) + " " + passage for _ in range(60)]
    chain = text(200)
    for _ in range(30):  # neighbours link, the ends do not
        rows.append(" ".join(chain))
        chain = chain[3:] + text(3)
    rows += ["one two three", "One  two\tTHREE", "one two four", "a b c d e", "A B C D E\n", "", "  ", None, "é É", "é É"]
    rows += ["exact copy of a text that is here many times over and over"] * 40
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3, rows[j]) for i, j in enumerate(order)] + [(None, rows[0]), (None, "alone with no id at all here"), (0, rows[order[0]])]


def same(got, rows):
    want = sorted(((k, *w) for (k, _), w in zip(rows, brute(rows), strict=True)), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == want


def test_components_equal_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, n int")
    same(jaccard_join.components(docs).collect(), rows)
    kept = jaccard_join.one_per_component(docs)
    assert kept.columns == docs.columns
    want = {c for (k, _), (_, c) in zip(rows, brute(rows), strict=True) if k is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_split_groups_and_buckets_give_the_same(spark, monkeypatch):
    rows = rows_of(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 20)
    monkeypatch.setattr(jaccard_join, "QUERIES_PER_TASK", 7)
    same(jaccard_join.components(docs).collect(), rows)


def test_empty_and_linkless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.components(none).count() == 0
    two = [(1, "a b c"), (2, "d e f"), (3, None)]
    same(jaccard_join.components(spark.createDataFrame(two, "doc_id long, text string")).collect(), two)


def test_long_text_and_chunks():
    texts = ["x y z " * 400_000, None, "a b c d e f"]
    found = {i: len(s) for i, s in arrow_text.shingle_sets(pa.array(texts))}
    assert found == {0: 3, 1: 0, 2: 2}
    rng = random.Random(3)
    many = ["".join(rng.choice("ab \n\tÄ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for at, to, data, offsets in arrow_text.chunks(pa.array(many), 300):
        w = arrow_text.words(data, offsets)
        got = [[bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
               for a, b in zip(w.first, w.first[1:], strict=False)]
        assert got == [[x.encode() for x in t.replace("\n", " ").replace("\t", " ").split(" ") if x] for t in many[at:to]]
        for a in np.unique(w.hashes):
            assert len({bytes(w.data[s:e]) for s, e in zip(w.starts[w.hashes == a], w.ends[w.hashes == a], strict=True)}) == 1


def test_component_labels(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 100), (5, 3)] + [(200, 200 + i) for i in range(1, 50)]
    got = dict(component_labels(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(200, 250)} == {200} and got[101] == 100
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_sets_that_link_are_sent_whole(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    runs = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(runs, 14))) for i in range(120)]  # all share runs, few of one other
    rows += [(200 + i, " ".join([*rows[0][1].split(), f"new{i}"])) for i in range(3)]
    docs, counts, sent = spark.createDataFrame(rows, "doc_id long, text string"), {}, jaccard_join._sent

    def counted(docs, key, text, ids, exact=True):
        counts[exact] = ids.count()
        return sent(docs, key, text, ids, exact)

    monkeypatch.setattr(jaccard_join, "_sent", counted)
    same(jaccard_join.components(docs).collect(), rows)
    assert counts == {False: 123, True: 4}


def test_starts_of_shingles_lose_no_link():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(-2**63, 2**63 - 1, 20_000))  # every start comes again
    base = [np.sort(rng.choice(pool, n, replace=False)) for n in (3, 50, 15_000, 12_000)]
    near = [np.sort(rng.choice(b, -(-len(b) * 9 // 10), replace=False)) for b in base]
    rows = [(i % 3 == 2, i % 4, i, len(t), t) for i, t in enumerate([*base, *near])]
    short = [(g, own, node, n, jaccard_join.starts(t)) for g, own, node, n, t in rows]
    left, right = jaccard_join._open(rows)
    assert left and set(left) | set(right) <= set(np.flatnonzero(jaccard_join._may_link(short)).tolist())
