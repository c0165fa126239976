import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haplodeck.llm import toxicity, warc_index
from haplodeck.llm.tables import scratch


@pytest.fixture(scope="module")
def pages(spark):
    long = "é" * 60 + "\r\n\r\n<p>" + "x" * 50
    rows = [(1, "http://www.b.org/x?q=1#f", "<p>\n\none\r\n\r\ntwo</p>" * 9), (2, "https://a.example.com:8080/B", "small"),
            (3, None, "small"), (4, "http://b.org/x?q=1", long), (5, "http://b.org/y y\n", long), (6, "", None), (7, "c", ""),
            (7, "c2", "dup id " * 30), (8, "c2", "dup id " * 30), (7, "c2", "dup id " * 30), (None, "n", long), (None, "n", "no id" * 40)]
    return spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, digest string")


def expected(rows):
    out, owner = [], {}
    for r in rows:
        raw = (r.html or "").encode()
        if len(raw) >= 100 and r.page_id is not None:
            owner[raw] = min(owner.get(raw, r.page_id), r.page_id)
    for r in rows:
        raw = (r.html or "").encode()
        first = owner.get(raw)
        other = first is not None and first != r.page_id
        out.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response",
                    first if other else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    got = warc_index.round_trip(pages)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == expected(pages.collect())
    assert warc_index.round_trip(pages.limit(0)).count() == 0


def test_archives_are_records_one_after_the_other(spark, pages):
    path = scratch(spark, "warc")
    warc_index.write_archives(warc_index.records(pages), path, archive_bytes=500)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert len(files) > 2
    cut = [x for f in files for x in warc_index._cut(gzip.decompress(f))]
    assert len(cut) == 12 and all(f["WARC-Type"] in ("response", "revisit") for f, *_ in cut)


def test_history_is_in_global_order(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    path = scratch(spark, "warc")
    warc_index.write_archives(warc_index.records(pages), path, archive_bytes=50_000)
    rows = warc_index.merged_history(warc_index.read_index(spark, path), range_rows=10).collect()
    assert len({r.run for r in rows}) > 3 and len({r.range for r in rows}) > 2
    rows.sort(key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count()


def test_loser_tree():
    rng = random.Random(6)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        got = [(head, run) for run, _, head in warc_index.LoserTree(runs)]
        assert got == sorted((x, i) for i, run in enumerate(runs) for x in run)


def labelled(spark, n=1500):
    rng = random.Random(7)
    plain = ["".join(rng.choice("aeioutn") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(3, 60))], i % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Gruzzle", "blorkify", "blork" + rng.choice(plain), "snarfed!"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None])))
        labels.append((i, int(bad)))
    rows += [(5001, None, "en"), (5002, "", "en"), (5003, "blork" + "x " * 200_000, None), (None, "gruzzle", "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels + [(3, 1), (None, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id != 3}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5001].score == by[5002].score and by[5001].predicted == 0 and by[5003].predicted == 1
    # neither language nor id nor labels are inputs
    moved = docs.selectExpr("doc_id + 7000 as doc_id", "text", "'zz' as lang")
    model = toxicity.train(docs, labels)
    one = {r[1] for r in toxicity.scores(docs, *model[:3], ("doc_id",)).collect()}
    assert one == {r[1] for r in toxicity.scores(moved, *model[:3], ("doc_id",)).collect()}


def test_without_labels(spark):
    docs, labels = labelled(spark, 30)
    assert {r.score for r in toxicity.held_out_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.score < 0.01 for r in toxicity.held_out_scores(docs, labels.where("toxic = 0")).collect())
    assert toxicity.held_out_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    docs, labels = labelled(spark)
    row = spark.range(8000, 9000).where(toxicity.fold("id") > 1).orderBy(F.xxhash64("id").desc()).first()
    rare = spark.createDataFrame([(row["id"], "zzyzx", "en", 1.0)], docs.schema)  # last by hash: in no bounded start
    docs, labels = docs.unionByName(rare), labels.unionByName(spark.createDataFrame([(row["id"], 1)], labels.schema))
    monkeypatch.setattr(toxicity, "START_PER_CLASS" if hasattr(toxicity, "START_PER_CLASS") else "TRAIN_PER_CLASS", 50)
    model = toxicity.train(docs, labels)[0]
    (_, _, ids, _), = toxicity.features(pa.array(["zzyzx"]))
    assert (model.w["emb"][0, ids[0, 0]] != toxicity.Classifier.fresh().w["emb"][0, ids[0, 0]]).any()
