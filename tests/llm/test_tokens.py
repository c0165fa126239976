import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from haplodeck.llm import byte_bpe, token_counts

ODD = ["", "  ", "a  b", "x\n\ny \n z", "it's we'll they're '", "'ll 'l 'r 've", "<|endoftext|>a", "b <|endoftext|>  c",
       "  <|endo", "日本語テキスト🙂🙂 é", "\x1c\x1d a", "a" * 1000, "ab" * 600 + " " * 300, "\t\tx", "½ ٣ ² x_y"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\t'slre.x1é<|endoftext|>日") for _ in range(30)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "mine") for i, t in enumerate(texts())]
    rows += [(500, None, None), (None, "no id", None), (7, ODD[7], "mine")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_library_s_count(spark, docs, library):
    for row in token_counts.prefix_table(docs.where("doc_id < 500")).collect():
        text = texts()[row.doc_id]
        step = 97 if len(text) > 200 else 1
        assert len(row.prefix_counts) == len(text)
        for k in range(step, len(text) + 1, step):
            assert row.prefix_counts[k - 1] == length(library, text[:k]), text[:k]


def test_counts_and_budget(spark, docs, library):
    got = [tuple(r) for r in token_counts.token_counts(docs, limit=5).collect()]
    assert len(got) == docs.count()
    for key, n_bytes, n, over, fits in got:
        text = "no id" if key is None else "" if key == 500 else texts()[key]
        assert (n_bytes, n, over) == (len(text.encode()), length(library, text), length(library, text) > 5)
        if len(text) < 200:
            assert fits == max([k for k in range(len(text) + 1) if length(library, text[:k]) <= 5])
    table = token_counts.prefix_table(docs)
    few = {r.doc_id: r for r in token_counts.fitting(token_counts.tokens_in(table, 4), 5).collect()}
    assert few[2].tokens == length(library, ODD[2][:4]) and few[0].tokens == 0 and few[0].fits == 0
    assert {r[0]: r[4] for r in got if r[0] is not None} == {k: r.fits for k, r in few.items() if k is not None}


def test_bpe_equals_the_library(spark, docs, data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    real = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    both = docs.select("doc_id", "text").unionByName(real.selectExpr("doc_id + 1000 as doc_id", "text"))
    by_id = {r.doc_id: r.text for r in both.collect()}
    for r in byte_bpe.encode(both).collect():
        assert r.ids == encoding.encode_ordinary(by_id[r.doc_id] or "") and r.decoded == (by_id[r.doc_id] or "")
    for r in byte_bpe.digests(both).collect():
        text = by_id[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_words_take_the_queue(spark):
    coder = byte_bpe.RecursiveCoder(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    words = ["".join(rng.choice("abest") for _ in range(150)) for _ in range(20)]
    slow = coder.encode(words)
    assert [coder._queue(w.encode()) for w in words] == [list(memoryview(ids).cast("i")) for ids, _ in slow]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none).count() == 0 and token_counts.prefix_table(none).count() == 0
    assert byte_bpe.digests(none).count() == 0 and byte_bpe.encode(none).count() == 0


def test_a_worker_keeps_no_rows_of_learnt_words():
    coder = byte_bpe.RecursiveCoder(P.path("byte_bpe_50k.tiktoken"))
    coder.encode(["some words to learn, some words", ""])
    left = {r[0] for r in coder.db.execute("SELECT table_name FROM duckdb_tables()").fetchall()}
    assert left == {"merges", "vocabulary"}


def test_a_word_is_one_row_and_a_query_s_words_are_of_like_length(monkeypatch):
    coder = byte_bpe.RecursiveCoder(P.path("byte_bpe_50k.tiktoken"))
    stored, store = [], coder._store
    monkeypatch.setattr(coder, "_store", lambda name, cols: (stored.append((name, cols)), store(name, cols)))
    monkeypatch.setattr(byte_bpe, "SQUARES_PER_QUERY", 4_000)
    rng = random.Random(3)
    words = ["".join(rng.choice("abestéß日") for _ in range(rng.choice((1, 3, 30)))) for _ in range(60)]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for word, (ids, data) in zip(words, coder.encode(words), strict=True):
        assert list(memoryview(ids).cast("i")) == encoding.encode_ordinary(word) and data == word.encode()
    sizes = [[len(t) for t in cols["tokens"].to_pylist()] for name, cols in stored if name == "letters"]
    assert sorted(sum(sizes, [])) == sorted(len(w.encode()) for w in set(words))
    assert len(sizes) > 3 and all(len(s) == 1 or len(s) * max(s) ** 2 <= 4_000 for s in sizes)
