import collections
import math
import re
import zlib

from pyspark.sql import functions as F

from haplodeck.llm import quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark, data):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "x\n\nx\n x\ny\ny", "é|# <b>\r\nü", "w " * 3000,
             "a b c d a b c " * 40] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, n_words string")
    rows = quality_rules.text_counts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COUNTS[:5]) == counted(texts[r.doc_id])


def test_bound_is_exact(spark):
    cases = [(k, n, r, e) for n in (10, 300, 2000) for k in (0, 1, 5, 15) for r in (0.01, 0.05) for e in (0.002, 0.1)]
    df = spark.createDataFrame(cases, "k long, n long, r double, e double")
    for row in df.withColumn("ok", quality_rules.few_enough(*map(F.col, "knre"))).collect():
        tail = sum(math.comb(row.n, i) * row.r ** i * (1 - row.r) ** (row.n - i) for i in range(min(row.k, row.n) + 1))
        assert row.ok == (tail <= row.e), row


def labelled(spark, n):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{clean} d{i}" if i % 4 else clean.replace(" ", "# ") + f" d{i}", "en" if i % 3 else None, "t") for i in range(n)]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, clean, "en", "t"), (n, None, "en", "t")],
                                 "doc_id long, text string, lang string, rule string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    return docs, labels


def test_certified_rules_reject_bad_documents_only(spark):
    docs, labels = labelled(spark, 3000)
    got = quality_rules.quality_verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id % 4 > 0 and r.doc_id < 3000)
        assert (r.failed_rules == "symbols") == (r.doc_id is not None and r.doc_id < 3000 and r.doc_id % 4 == 0)
    left = quality_rules.kept_documents(docs, labels)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)


def test_a_small_language_is_not_rejected_by_a_cutoff_of_all(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    bad = clean.replace(" ", "# ")
    rows = [(i, f"{clean if i < 3000 else bad} d{i}", "en") for i in range(4000)]
    rows += [(5000 + i, f"{bad if i < 9 else clean} d{i}", "xx") for i in range(60)]  # good ones, 15 % beyond
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(not 3000 <= r[0] < 4000)) for r in rows], "doc_id long, quality int")
    cutoffs = quality_rules.certified_cutoffs(quality_rules.text_counts(docs), labels).collect()
    assert {(r.stratum, r.rule) for r in cutoffs} == {("en", "symbols"), (quality_rules.POOLED, "symbols")}
    left = {r.doc_id for r in quality_rules.kept_documents(docs, labels).collect()}
    assert left == {*range(3000), *range(5000, 5060)}


def test_without_enough_labels_only_the_base_verdict_counts(spark):
    docs, labels = labelled(spark, 40)
    assert all(r.kept != r.base_failed for r in quality_rules.quality_verdicts(docs, labels).collect())
    assert all(r.kept != r.base_failed for r in quality_rules.quality_verdicts(docs, labels.limit(0)).collect())
    assert quality_rules.quality_verdicts(docs.limit(0), labels).count() == 0


def checked(spark, rows, shards):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(docs, shards).collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    sizes = [len(per[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    return {(r.doc_id, r.text_crc32): r.shard for r in got}


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rows = [(i, f"text {i // 3 if i < 90 else i}é") for i in range(400)] + [(None, "n"), (5, None), (6, ""), (7, "")]
    at = checked(spark, rows, 8)
    crc = [zlib.crc32(f"text {g}é".encode()) for g in range(30)]
    assert sum(len({at[(i, crc[g])] for i in range(3 * g, 3 * g + 3)}) == 1 for g in range(30)) == 30


def test_one_text_of_all_rows_and_other_extremes(spark):
    checked(spark, [(i, "same") for i in range(300)], 7)
    checked(spark, [(i, "hot" if i % 3 else f"u{i}") for i in range(300)], 24)
    checked(spark, [(1, "a"), (1, "a"), (1, "a")], 5)
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
