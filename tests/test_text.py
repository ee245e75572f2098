"""Text functions on small examples."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "s string").select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("given", "want"),
    [("Hello, World!", "hello world"), ("  a\t\nb  ", "a b"), ("snake_case 42%", "snake_case 42"), ("", ""), (None, ""), ("...", ""), ("Điều 5: Ủy ban", "điều 5 ủy ban")],
)
def test_normalized(spark, given, want):
    assert one(spark, given, T.normalized("s")) == want


def test_composed_form(spark):
    loose = unicodedata.normalize("NFD", "Ủy ban é")
    assert one(spark, loose, T.composed("s")) == "Ủy ban é"
    assert one(spark, None, T.composed("s")) == ""


def test_tokens_drop_stop_words_and_keep_the_rest(spark):
    assert one(spark, "Không bị phạt và cấm", T.tokens("s")) == ["bị", "phạt", "cấm"]
    assert one(spark, "không", T.tokens("s", stop=())) == ["không"]
    assert one(spark, "nhà nước", T.tokens("s", segment=lambda c: F.replace(c, F.lit(" "), F.lit("_")))) == ["nhà_nước"]
    assert one(spark, " ", T.tokens("s")) == []


def test_segmenter(spark):
    join = T.segmenter(["nhà nước", "nhà nước pháp quyền", "bị"])
    assert one(spark, "Nhà nước pháp quyền, nhà  nước; nhà nướcx", join(F.col("s"))) == "Nhà_nước_pháp_quyền, nhà_nước; nhà nướcx"


def test_blake_hash(spark):
    import hashlib

    want = int.from_bytes(hashlib.blake2b("từ".encode(), digest_size=8).digest(), "big", signed=True)
    assert one(spark, "từ", H.blake_hash(F.col("s"))) == want and one(spark, None, H.blake_hash(F.col("s"))) is None


def test_ngrams(spark):
    words = T.words("s")
    assert one(spark, "a b c d", T.ngrams(words, 2)) == ["a b", "b c", "c d"]
    assert one(spark, "a b a b", T.ngrams(words, 2)) == ["a b", "b a"]
    assert one(spark, "a b", T.ngrams(words, 5)) == ["a b"]
    assert one(spark, "", T.ngrams(words, 5)) == []


def test_folding(spark):
    assert one(spark, "Đường Trần Hưng Đạo", T.folded("s"), T.accented("s")) == ("Duong Tran Hung Dao", True)
    assert one(spark, "plain", T.folded("s"), T.accented("s")) == ("plain", False)
    assert one(spark, "đi", T.accented("s"))
    for letter in "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ":
        plain = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn").replace("đ", "d")
        source, target = T.fold_table()
        assert target[source.index(letter)] == plain


def test_syllables_and_parts(spark):
    assert one(spark, "Ăn cơm, chưa?", T.syllables("s")) == ["ăn", "cơm", "chưa"]
    assert one(spark, "a, b!", T.parts("s")) == ["a", ", ", "b", "!"]
    assert one(spark, "", T.parts("s")) == []


def test_recased(spark):
    case = lambda new, old: one(spark, "", T.recased(F.lit(new), F.lit(old)))
    assert [case("được", "DUOC"), case("được", "Duoc"), case("được", "duoc"), case("ở", "O")] == ["ĐƯỢC", "Được", "được", "Ở"]


def test_ids(spark):
    document, number = T.article_id("s")
    assert one(spark, "10/2020/nd-cp+7", document, number) == ("10/2020/nd-cp", 7)
    assert one(spark, "a+b+12", document, number) == ("a+b", 12)
    for bad in ("none", "a+b", "a+", None):
        with pytest.raises(Exception, match="not an article id"):
            one(spark, bad, document)
    assert one(spark, "x#y#3", T.article_of("s")) == "x#y"
    with pytest.raises(Exception, match="not a chunk id"):
        one(spark, "x", T.article_of("s"))


def test_snippet(spark):
    assert one(spark, "Title. body text", T.snippet("s", F.lit("Title"))) == "body text"
    assert one(spark, "one two three", T.snippet("s", limit=9)) == "one two ..."
    assert one(spark, "onetwothree", T.snippet("s", limit=5)) == "onetw ..."
    assert one(spark, None, T.snippet("s")) == ""


def test_half_stripping_is_fixed_by_key_and_seed(spark):
    text = " ".join(["đường"] * 200)
    a, b, c = one(spark, text, T.half_stripped("s", F.lit(1)), T.half_stripped("s", F.lit(1)), T.half_stripped("s", F.lit(2)))
    assert a == b != c
    assert 60 < a.split().count("duong") < 140


def test_listed(spark):
    terms = F.array(F.struct(F.lit("a").alias("term"), F.lit(1.5).alias("score")), F.struct(F.lit("b").alias("term"), F.lit(1.0).alias("score")))
    assert one(spark, "", T.listed(terms)) == "a (1.5), b (1)"
    assert one(spark, "", T.listed(F.slice(terms, 1, 0))) == "(no matching word)"


def test_hashes_and_sets(spark):
    same = spark.createDataFrame([("Hello, World", "hello   world!")], "a string, b string").select(H.content_hash(F.col("a")) == H.content_hash(F.col("b"))).first()[0]
    assert same
    arrays = lambda *x: F.array(*(F.lit(v) for v in x))
    none = F.array().cast("array<string>")
    assert one(spark, "", H.jaccard(arrays("a", "b"), arrays("b", "c")), H.jaccard(none, none)) == (1 / 3, 0.0)
    assert one(spark, "", H.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), H.band(F.lit(-1).cast("long"), 7, 8)) == (64, 255)


def test_simhash_is_the_majority_of_bits(spark):
    words = ["x", "y", "z", "x y", "tail"]
    import hashlib

    want = 0
    for bit in range(64):
        votes = sum(int(hashlib.md5(w.encode()).hexdigest()[:16], 16) >> bit & 1 for w in words)
        want |= (2 * votes > len(words)) << bit
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.agg(H.simhash(H.token_hash(F.col("w"))).alias("c")).first().c
    assert got % (1 << 64) == want
    assert rows.where("w = ''").agg(H.simhash(H.token_hash(F.col("w"))).alias("c")).first().c == 0


def test_decomposed_text_is_as_composed(spark):
    """An accent that is a character of its own changes neither words nor hashes, search or restoring."""
    import unicodedata

    from siltstone.functions import hashing as H
    from siltstone.operators import restoring, sparse

    whole = "Luật Giao thông đường bộ, Điều 5: Người điều khiển xe"
    parted = unicodedata.normalize("NFD", whole)
    assert parted != whole
    rows = spark.createDataFrame([(1, whole), (2, parted)], "article_id long, text string")
    found = rows.select(T.tokens("text").alias("t"), T.words("text").alias("w"), T.syllables("text").alias("s"), T.folded_syllables("text").alias("f"), T.normalized("text").alias("n"), H.content_hash(F.col("text")).alias("h"), T.folded("text").alias("p"))
    a, b = found.collect()
    assert a == b and "thông" in a.t and a.f[:2] == ["luat", "giao"]
    run = sparse.search(spark.createDataFrame([(7, unicodedata.normalize("NFD", "giao thông"))], "query_id long, text string"), rows, 5).collect()
    assert {r.article_id for r in run} == {1, 2} and len({r.score for r in run}) == 1
    model = restoring.train(rows)
    assert {r.w for r in model.words.collect()} == set(a.s)
    again = restoring.restored(spark.createDataFrame([(parted,), ("luat giao thong",)], "text string"), model).select("restored").collect()
    assert [r.restored for r in again] == [whole, "luật giao thông"]
