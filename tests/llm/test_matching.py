import random

import numpy as np
import pytest

from haplodeck.llm import decontam, license_scan


def align(a, b):
    """Plain local alignment."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, above[j] + (decontam.MATCH if x == y else decontam.MISMATCH),
                           above[j + 1] + decontam.GAP, now[j] + decontam.GAP))
        best, above = max(best, *now), now
    return best


def test_alignment_equals_the_plain_table():
    rng = random.Random(4)
    left = [np.array([rng.randrange(6) for _ in range(rng.randint(1, 20))], np.uint64) for _ in range(80)]
    right = [np.array([rng.randrange(6) for _ in range(rng.randint(1, 40))], np.uint64) for _ in range(80)]
    score, _ = decontam.alignment_scores(left, right)
    assert score.tolist() == [align(a, b) for a, b in zip(left, right, strict=True)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(i, text(rng.randint(15, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (3, "a clash of ids here now")]
    plants, docs = {}, []
    for i in range(30):
        w = items[i][1].split()
        edited = list(w)
        for _ in range(len(w) // 8):
            edited[rng.randrange(len(w))] = "other"
        del edited[len(w) // 2]
        for kind, passage in enumerate((" ".join(w), ", ".join(w).upper() + "!", " ".join(edited))):
            key = 10 * i + kind
            docs.append((key, f"{text(100)} {passage} {text(50 * kind)}"))
            plants[key] = i
    docs += [(1000 + i, text(120)) for i in range(60)] + [(2000, None), (2001, ""), (2002, "so two words it is")]
    docs += [(3000 + i, text(20) + " " + items[0][1]) for i in range(40)]  # a passage many texts share
    return (spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, item_id string"),
            spark.createDataFrame([(*t, 0.5) for t in items], "item_id long, text string, score double"), plants)


def test_leaks_are_found_and_clean_texts_left_alone(tables):
    docs, items, plants = tables
    got = {(r.doc_id, r.item_id): r for r in decontam.best_leaks(docs, items).collect()}
    want = set(plants.items()) | {(3000 + i, 0) for i in range(40)} | {(2002, 32)}
    assert set(got) == want
    assert all(got[k].score == 1 for k in want if k[0] % 10 < 2 and k[0] < 1000)
    left = decontam.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {k[0] for k in want}


def test_blocks_of_items_give_the_same(tables):
    docs, items, _ = tables

    def rows(**options):
        return sorted(tuple(r) for r in decontam.leaks(docs, items, **options).collect())

    assert rows(block_words=300) == rows()


def test_seeds_cover_every_stretch():
    rng = np.random.default_rng(1)
    item = np.repeat(np.arange(5), [1, 3, 4, 9, 40])
    chosen = decontam.rarest(rng.integers(0, 5, len(item)), item)
    for i in range(5):
        own = chosen[item == i]
        assert all(own[a:a + decontam.WINDOW].any() for a in range(max(1, len(own) - decontam.WINDOW + 1)))


@pytest.mark.parametrize("step", [4, 5, 6])
def test_a_sole_copy_with_every_nth_word_replaced_is_found(spark, step):
    rng = random.Random(step)
    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate((15, 22, 30, 61))]
    docs = []
    for i, w in items:
        copy = [f"e{k}" if k % step == step - 1 else x for k, x in enumerate(w)]
        docs.append((i, [f"f{rng.randrange(99)}" for _ in range(40)] + copy + ["tail"] * 9))
    want = {}
    for d, text in docs:
        for i, w in items:
            score = align(w, text) / (decontam.MATCH * len(w))
            if score >= decontam.THRESHOLD:
                want[d, i] = score
    assert len(want) == len(items)
    got = decontam.best_leaks(
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want


def test_portions_of_hits_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(decontam, "_PAIRS", 10)
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 30, 200))
    many = rng.integers(1, 9, 200)
    cut = list(decontam._portions(doc, many))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == 200
    assert all(b == 200 or doc[b - 1] != doc[b] for _, b in cut)
    assert all(many[a:b].sum() <= 10 or len(set(doc[a:b])) == 1 for a, b in cut)


def test_null_and_shared_keys_go_by_their_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(None, "so one two three four five six it is"), (None, "clean"), (7, "one two three four five six"), (7, "clean too"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {tuple(r) for r in decontam.clean_documents(docs, items).collect()}
    assert left == {(None, "clean"), (7, "clean too"), (8, None)}


def test_decontamination_of_empty_tables(tables):
    docs, items, _ = tables
    assert decontam.best_leaks(docs.limit(0), items).count() == 0
    assert decontam.best_leaks(docs, items.limit(0)).count() == 0
    assert decontam.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_licences_equal_containment_by_brute_force(spark, data):
    mit = license_scan.TEMPLATES["MIT"][3]
    rows = [(1, "foo bar " + mit + " tail"), (2, "x " * 500 + mit.replace("sublicense", "x").upper()), (3, None), (4, ""),
            (5, " ".join(mit.split()[:30])), (6, "released under the mit license\n" * 3), (6, "Released under the MIT License"),
            (None, "Licensed under CC BY-NC 4.0.")]
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, 1) for r in rows + real], "doc_id long, text string, template int")
    got = license_scan.licenses(docs).collect()

    def words(t):
        return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split()

    def contained(t, text):
        a, b = words(t), words(text)
        own = {tuple(a[i:i + 5]) for i in range(len(a) - 4)}
        return len(own & {tuple(b[i:i + 5]) for i in range(len(b) - 4)}) / len(own)

    want = {(k, name) for k, text in rows + real for name, ts in license_scan.TEMPLATES.items()
            if any(contained(t, text) >= license_scan.CONTAINED for t in ts)}
    assert {(r.doc_id, r.license_id) for r in got} == want
    assert {r.n_found for r in got if r.doc_id == 6} == {4}  # three lines and a repeated id
    assert license_scan.collision_probability(0.8) > 0.99
    assert license_scan.licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.notices(docs, {"x": ["too short"]})


def found_licences(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [set() for _ in texts]
    for r in license_scan.licenses(docs).collect():
        got[r.doc_id].add((r.license_id, r.n_found))
    return got


def test_versions_and_other_licences_get_their_own_id(spark):
    gnu = license_scan.TEMPLATES["GPL-3.0"][1]
    bsd3 = license_scan.MORE_TEMPLATES["BSD-3-Clause"][0]
    assert found_licences(spark, [
        gnu, gnu.replace("version 3", "version 2"), gnu.replace("GNU General", "GNU Affero General"),
        gnu.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
        "It is licensed under the GNU General Public License, version 2", "licensed under the GNU General Public License, version 3",
        bsd3, bsd3.split(" 3. ")[0],
        license_scan.MORE_TEMPLATES["ISC"][0], license_scan.MORE_TEMPLATES["Unlicense"][0],
        "// SPDX-License-Identifier: mit", "x\n# spdx-license-identifier: (GPL-2.0-only WITH Linux-syscall-note OR ISC)\ny z",
        "SPDX-License-Identifier:", "MIT"]) == [
            {("GPL-3.0", 1)}, {("GPL-2.0", 1)}, {("AGPL-3.0", 1)}, {("LGPL-2.1", 1)}, {("GPL-2.0", 1)}, {("GPL-3.0", 1)},
            {("BSD-3-Clause", 1)}, {("BSD-2-Clause", 1)}, {("ISC", 1)}, {("Unlicense", 1)}, {("MIT", 1)}, {("GPL-2.0-only", 1), ("ISC", 1)},
            set(), set()]


def test_interrupted_notices_are_found(spark):
    mit = license_scan.TEMPLATES["MIT"][3].split()

    def cut(at, n):
        return " ".join([*mit[:at], *[f"x{i}" for i in range(n)], *mit[at:]])

    assert found_licences(spark, [
        cut(43, 24), cut(43, 30), cut(43, 400), cut(30, 40), f"{cut(43, 60)} and {cut(43, 60)}", f"{cut(43, 60)} and {cut(0, 0)}",
        " ".join(mit[:43])]) == [
            {("MIT", 1)}, {("MIT", 1)}, {("MIT", 1)}, {("MIT", 1)}, {("MIT", 2)}, {("MIT", 2)}, set()]
