import pytest

from siltstone.operators import chunking


def made(spark, title, text, **options):
    rows = spark.createDataFrame([("a1", title, text)], "article_id string, title string, text string")
    return [(r.chunk_id, r.text) for r in chunking.chunks(rows, **options).orderBy("chunk_no").collect()]


def words(n, mark="w"):
    return " ".join(f"{mark}{k}" for k in range(n))


def test_short_text_is_one_chunk(spark):
    assert made(spark, "T", "one two") == [("a1#0", "T. one two")]


def test_long_clause_slides_and_ends_at_its_last_word(spark):
    found = made(spark, "T", words(400), most=180, overlap=40)
    bodies = [t.removeprefix("T. ").split() for _, t in found]
    assert [len(b) for b in bodies] == [180, 180, 120]
    assert bodies[0][140:] == bodies[1][:40]
    assert bodies[-1][-1] == "w399"


def test_clauses_are_packed_but_not_cut(spark):
    text = "1. " + words(100, "a") + "\n2. " + words(60, "b") + "\n3. " + words(100, "c")
    bodies = [t.split() for _, t in made(spark, "T", text, most=180, overlap=40)]
    assert len(bodies) == 2
    assert bodies[1][1] == "3."


def test_long_clause_closes_the_open_window(spark):
    text = "1. " + words(10, "a") + "\n2. " + words(30, "b") + "\n3. " + words(5, "c")
    sizes = [len(t.removeprefix("T. ").split()) for _, t in made(spark, "T", text, most=20, overlap=5)]
    assert sizes == [11, 20, 16, 6]


@pytest.mark.parametrize(("title", "text", "want"), [("T", "", ["T"]), ("T", " \n ", ["T"]), ("", None, ["a1"]), (None, "x", [". x"])])
def test_nothing_to_cut(spark, title, text, want):
    assert [t for _, t in made(spark, title, text)] == want


def test_limit(spark):
    assert len(made(spark, "T", words(2000), limit=3)) == 3


def test_clauses(spark):
    rows = spark.createDataFrame([("1. a\n2. b 10. c\n\n 12. d\nmore",)], "t string")
    assert rows.select(chunking.clauses("t").alias("c")).first().c == ["1. a", "2. b 10. c", "12. d\nmore"]


def test_overlap_as_large_as_the_window(spark):
    assert len(made(spark, "T", words(5), most=3, overlap=3)) == 3
