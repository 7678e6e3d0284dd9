import pytest

# rows that every operator must take: null ids and texts, empty, one word, ties,
# repeated rows, a very long text, and extra columns whose names operators use
LONG = " ".join(f"wort{i % 977}" for i in range(30000))


@pytest.fixture(scope="session")
def edge(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
        (2, "One two three four five six seven eight nine ten eleven twelve", "a"),
        (2, "one two three four five six seven eight nine ten eleven twelve", "a"),
        (3, "one two three four five six seven eight nine ten eleven twelve", None),
        (3, "one two three four five six seven eight nine ten eleven twelve", None),
        (4, None, "b"),
        (5, "", "b"),
        (6, " \n\t ", None),
        (7, "word", "c"),
        (8, LONG, "c"),
        (9, LONG + " tail", "c"),
        (10, "mail me: a.b@c.example.org or +1 (555) 010-2030, 10.0.0.1 \U0001f642 é", "c"),
        (None, "row without an id, kept as it is", "d"),
        (None, None, None),
    ]
    return spark.createDataFrame(
        [(i, t, s, len(t or ""), 1, 2, "x", True) for i, t, s in rows],
        "doc_id long, text string, source string, n_chars long, _row int, n int, shard string, selected boolean")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("doc_id = -99")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
