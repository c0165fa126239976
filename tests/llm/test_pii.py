import hashlib
import re

from haplodeck.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    t, out = text or "", []
    for k, (p, ok) in enumerate((
        (EMAIL, lambda v: True),
        (IP, lambda v: all(int(x) <= 255 for x in v.split("."))),
        (CARD, lambda v: 14 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
        (PHONE, lambda v: 10 <= len(re.sub(r"\D", "", v)) <= 15),
    )):
        out += [(m.start(), k, m.end()) for m in p.finditer(t) if ok(m[0])]
    return sorted(out)


def expected(text):
    spans = base(text)
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*[sum(s[1] == k for s in spans) for k in range(4)],
            hashlib.sha256(joined.encode()).hexdigest()), joined


ODD = [
    None, "", " ", "a@b.c", "a@b.c_x@y.z", "x@y.z@w.v.", "é🙂 a.b+c@d-e.f.g! 1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1",
    "007.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-2000 +12", "+1 23 456 7890 12345678",
    "4111111111111111 " * 300, "a" * 20000 + "@", "1" * 20000, "1.1." * 3000, "x@" + "y." * 3000 + "z",
    "+" * 3000 + "1", "m@n.oo " * 700, "+1-2-3-4-5-6-7-8-9-0 +10.20.30.40.50",
]


def test_base_spans_equal_brute_force(spark, data):
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        counts, joined = expected(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == counts, (i, t[:80])
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))


def test_terms_that_give_a_value_away(spark):
    rows = []
    for i in range(300):
        rows.append((i, f"talk with them about plain words tomorrow, filler {chr(97 + i % 26)}{i} stay as they are", "x"))
    for i in range(5):
        rows.append((1000 + i, f"Talk {chr(97 + i)}eta with Zorblatt about it: zed@mail.org tomorrow {'abcde'[i] * 4}", "y"))
    rows.append((2000, "Zorblatt, was seen again", "z"))
    rows += [(3000 + i, "copy of Quuxine near ann@mail.org here", "z") for i in range(50)]
    rows += [(4000, None, None), (None, "null key a@b.cc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(rows)
    # with 358 texts, 6 with the term, 5 with the value, 5 with both: log(358*5/30) / log(358/5) = 0.957
    assert got[2000].spans == "general:0:8" and got[2000].n_terms == 1
    assert all(got[i].n_terms == 0 for i in range(300))
    assert got[3000].n_terms == 0  # copies are one surrounding
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert clean[2000].text == "[NAME], was seen again" and clean[0].text == rows[0][1]
    assert clean[1000].text == "Talk aeta with [NAME] about it: [EMAIL] tomorrow aaaa"
    assert clean[4000].text is None and clean[2000].spans == "z" and clean[None].text == "null key [EMAIL]"


def test_handles_numbers_and_short_names_are_sanitised(spark):
    rows = [(i, f"talk with them about plain words tomorrow, filler {chr(97 + i % 26)}{i} stay as they are") for i in range(300)]
    rows += [(1000 + i, f"Talk {c}eta with jdoe42, K-1187 j_doe j.doe Bo: zed@mail.org 10.2.3.4 tomorrow {c * 4}") for i, c in enumerate("abcde")]
    rows += [(2000, "k-1187 again, filler a0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1000] == "Talk aeta with , [NAME]   : [EMAIL] [IP] tomorrow aaaa"
    assert clean[2000] == "[WORD] again, filler a0"
    assert all(clean[i] == t for i, t in rows[:300])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(docs).count() == 0
    assert pii.sanitised(docs).count() == 0
