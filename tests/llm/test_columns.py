"""Other columns come back as they were, whatever their names."""

from haplodeck.llm import decontam, jaccard_join, pii

NAMES = "doc_id long, text string, _hash string, _leak_hash string, _spans string, `a.b` int"
ROWS = [(1, "write to ann@example.org now please", "h1", "l1", "s1", 7), (2, "nothing to see in here", "h2", "l2", "s2", 8),
        (3, None, None, None, None, None)]


def test_sanitised_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame(ROWS, NAMES)
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got[1] == (1, "write to [EMAIL] now please", *ROWS[0][2:]) and got[2] == ROWS[1] and got[3] == ROWS[2]


def test_clean_documents_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame(ROWS, NAMES)
    items = spark.createDataFrame([(9, "nothing to see in here")], "item_id long, text string")
    out = decontam.clean_documents(docs, items)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [ROWS[0], ROWS[2]]


def test_one_per_component_keeps_dotted_columns(spark):
    docs = spark.createDataFrame([*ROWS, (4, *ROWS[1][1:])], NAMES)
    out = jaccard_join.one_per_component(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == ROWS
