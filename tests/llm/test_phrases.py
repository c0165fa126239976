import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from haplodeck.llm import phrases as ph
from haplodeck.llm import queries


def expected(rows, least, top):
    """lang -> ranked rows, by counters over the texts."""
    f, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        gone = {p[i:i + k] for p, n in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                if 100 * n >= 80 * c[p[i:i + k]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def made(seed, n=400):
    """Texts with frequent words, phrases inside phrases, a pair that begins a third of all suffixes, odd blanks."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words.append(rng.choice(["the", "of", "New York City", "new york", "hot pair " + rng.choice("abcdefgh"), "hot pair x y",
                                     "é ß", "rare%d" % rng.randrange(300), "a b c d", ".", "\t", ",x", "\x0b", "z\n"]))
        rows.append((" ".join(words), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("same words here and there now. " * 40, "fr"), ("w " * 200, "fr")]


def collected(spark, rows, **options):
    df = spark.createDataFrame([(t, g, "x") for t, g in rows], "text string, lang string, word string").repartition(4)
    return sorted(tuple(r) for r in ph.collocations(df, **options).collect())


@pytest.mark.parametrize("hot", [1024, 40])
def test_equals_counters(spark, monkeypatch, hot):
    monkeypatch.setattr(ph, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(ph, "_HOT", hot)
    rows = made(3)
    got = collected(spark, rows)
    assert got == expected(rows, 30, 2000) and len(got) > 20


def test_ties_at_the_last_place_and_small_tables(spark):
    rows = [("ab cd. xy zw. mn op. ef gh", "en")] * 30
    got = collected(spark, rows, top=2)
    assert got == expected(rows, 30, 2) and [r[2] for r in got] == ["ab cd", "ef gh"]
    assert collected(spark, rows[:29]) == [] and collected(spark, []) == []


def test_statement_and_whole_table(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_collocations"](spark, data).collect())
    assert got == sorted(con.execute(queries.ORACLE["op11_collocations"]).fetchall())
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got == expected(rows, 30, 2000)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    suffix = rng.integers(1, 4, (500, 4)).astype(np.uint64)
    suffix[rng.random(500) < 0.2, 2:] = 0
    n = rng.integers(1, 4, 500)
    for least in (1, 20):
        got = {tuple(suffix[i][:d].tolist()): total for d, i, total in ph.equal_parts(suffix, n, (least,) * 4)}
        want = Counter()
        for row, k in zip(suffix.tolist(), n.tolist()):
            for d in range(1, 5):
                if row[d - 1]:
                    want[tuple(row[:d])] += k
        assert got == {p: c for p, c in want.items() if c >= least}


def test_a_block_of_text_takes_little_memory():
    texts = pa.array([" ".join(f"w{i * j % 7919}" for j in range(1, 2000)) + "." for i in range(1, 700)])
    data, offsets = next(c[2:] for c in ph.chunks(texts, ph.BLOCK_BYTES))
    assert len(data) > 3 << 20
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * (len(offsets) - 1)), texts[:len(offsets) - 1]], ["lang", "text"])

    class Mapped:  # stands for a DataFrame and keeps what its tasks run
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    step = Mapped()
    ph._routed(step, {d: np.zeros(0, np.uint64) for d in (2, 3)}, 64)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in step.run(iter([rows]))) == 64
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()


def test_words_of_a_block_are_summed_over_its_parts(spark, monkeypatch):
    monkeypatch.setattr(ph, "CHUNK_BYTES", 60)
    rows = made(5, 60)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1).selectExpr(
        "coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    per_block = []
    plain = ph._summed
    monkeypatch.setattr(ph, "_summed", lambda k, n: per_block.append(len(k)) or plain(k, n))
    step = type("Mapped", (), {"mapInArrow": lambda self, run, schema: setattr(self, "run", run) or self})()
    ph._routed(step, {d: np.zeros(0, np.uint64) for d in (2, 3)}, 1)
    got = Counter()
    for batch in step.run(iter(df.toArrow().to_batches())):
        for r in batch.to_pylist():
            got[r["lang"]] += int(ph.unpack(r["counts"]).sum())
    want = Counter()
    for batch in df.toArrow().to_batches():
        for lang, data, offsets in ph._texts(iter([batch])):
            want[lang] += int((ph.suffixes(data, offsets)[2][:, 1] > 0).sum())
    assert got == want and max(per_block) > 2


def test_a_language_of_two_words(spark):
    assert collected(spark, [("two words", "xx")] + [("ab cd", "en")] * 30) == [
        ("en", 1, "ab cd", 30, 30, 30, 60, 1000000)]
