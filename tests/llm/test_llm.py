"""The ten operators against brute force on small tables, and their behaviour on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import (
    decontaminate, html_extract, kernels, language, minhash, packing, pii, quality_model, quality_rules, registry, secrets, substrings,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def documents(spark, *texts, parts=3):
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("the", "on", "er", "in", "st", "an")) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, prose(1)), (5, prose(1)), (None, prose(1)), (6, "é ü ß 漢字 😀"), (7, prose(2)), (8, prose(2))]
    df = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None) for k, (i, t) in enumerate(rows)], SCHEMA)
    for name in ("row", "n", "key", "kept", "rep", "gram", "spans", "piece", "share", "count", "h1", "comp"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(5, 1, 0), (7, 1, 0), (7, 1, None), (8, 0, 1), (None, 1, 0), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- 1: secrets --------------------------------------------------------------------------------------------


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def secret_texts():
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = []
    for k in range(60):
        pieces = [prose(k, 12), f"😀 password = '{hexa(12)}'", f"API_KEY:{hexa(40)}", f"AKIA{hexa(16).upper()}", "AKIA123", hexa(31), hexa(64), f'"token"="{hexa(7)}"', "Secret : a.b-c_d=e/f+g", "ſecret=abcdefghij", "token=\nabcdefgh"]
        made.append(" ".join(rng.sample(pieces, rng.randint(1, 6))))
    return made


def test_secrets_base_spans(spark):
    texts = secret_texts()
    got = by_id(secrets.found(documents(spark, *texts)))
    for k, text in enumerate(texts):
        want = base_secrets(text)
        row = got[k]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(x[1] == j for x in want) for j in range(3))
        joined = ",".join(f"{secrets.KINDS[kind]}:{s}:{e}" for s, kind, e in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_secrets_grammar_adds_formats_and_leaves_words(spark):
    rng = random.Random(8)
    key = lambda: "sk_live_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    texts = [f"{prose(k, 20)} token={key()}" for k in range(120)] + [f"see {key()} here", "internationalisation-of-documents-2020 and-some-other-long-hyphenated-words"]
    got = by_id(secrets.found(documents(spark, *texts)))
    assert got[120].n_grammar == 1 and got[120].spans.startswith("grammar:4:")
    assert got[121].n_grammar == 0


def test_secrets_find_unlabelled_credentials_of_learned_formats(spark):
    """Of planted credentials without a label nine in ten are found; words, numbers and other runs stay."""
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    formats = [lambda: some("0123456789abcdef", 24), lambda: "ghx." + some("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 20), lambda: "sk-" + some("abcdefghijkmnpqrstuvwxyz", 3) + "-" + some("0123456789", 10)]
    texts = [f"{prose(k, 20)} api_key: {formats[k % 3]()}" for k in range(300)]
    planted = [f"{prose(k, 9)} {formats[k % 3]()}. {prose(k, 5)}" for k in range(90)]
    clean = [f"{prose(k, 40)} internationalisation {some('0123456789', 9)} reference-number-{k} www.example.com/path/to/page {some('abcdefgh', 12)}" for k in range(200)]
    got = by_id(secrets.found(documents(spark, *texts, *planted, *clean)))
    assert sum(got[300 + k].n_grammar == 1 for k in range(90)) >= 81
    assert sum(got[390 + k].n_grammar for k in range(200)) <= 2
    assert all(got[390 + k].n_candidates >= 4 for k in range(200))


def test_automaton_merges_compatible_states():
    rng = random.Random(1)
    words = ["aa" * int(1 + rng.expovariate(0.4)) for _ in range(400)]
    automaton = secrets.Automaton(words)
    assert len(automaton.states) < 6 < max(map(len, words))
    assert automaton.score("aaaaaaaa") > automaton.score("0000zzzz")


def test_secrets_redaction(spark):
    docs = documents(spark, "a password=abcdefgh b", None, "clean")
    rows = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(docs).collect()}
    assert rows[0] == ("a [SECRET] b", 12) and rows[1][0] is None and rows[2] == ("clean", 5)


# --- 2: packing --------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary_file()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", None, "Hello, World! it's", "a b　c \x01 \x01x é <|endoftext|>", prose(3, 9000), "x" * 9000, *(prose(k, random.Random(k).randint(1, 700)) for k in range(40))]
    got: dict = {}
    for r in packing.packed(documents(spark, *texts), path).collect():
        got.setdefault(r.doc_id, []).append(r)
    bins: dict = {}
    total = 0
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        rows = sorted(got[k], key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(ids), 2048)) and [r.piece for r in rows] == list(range(len(rows)))
        for r in rows:
            part = ids[r.start : r.start + 2048]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_words_are_encoded_once_in_all_their_cases_and_marks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from siltstone.llm import common

    encoder, tokenizer = packing.Encoder(packing.vocabulary_file()), Tokenizer.from_file(packing.vocabulary_file())
    words = sorted({*(prose(k, 3).split()[0] for k in range(300)), "été", "straße", "über"})
    texts = [mark.format(case(w)) for w in words for case in (str.lower, str.capitalize) for mark in ("{}", "{}.", "({})", '"{}",', "{}12")]
    parts = ["a", "É", "ß", "×", "ÿ", "e\u0301", "\u0301", "œ", "İ", "'s", "'LL", "7", "٣", ".", "<|endoftext|>", "<|Endoftext|>", "endoftext", " ", "\n", "\x01", "\x1c", "\x85", "漢", "한", "😀"]
    rng = random.Random(8)
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for some, most in ((texts, len(words) + 20), (odd, len(odd) * 10)):
        ids, firsts = encoder.encode(*common.utf8(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert len(encoder.keys) <= most


def test_fullest_combination_is_optimal():
    rng = random.Random(6)
    for _ in range(40):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 12)))
        room = rng.randint(0, 60)
        items = list(counts.elements())
        best = max(s for m in range(1 << len(items)) if (s := sum(x for k, x in enumerate(items) if m >> k & 1)) <= room)
        found = packing.fullest(dict(counts), room)
        assert sum(a * b for a, b in found) == best and all(counts[a] >= b for a, b in found)


# --- 3: near-duplicates --------------------------------------------------------------------------------------


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(words)
    texts = [prose(k, rng.randint(30, 80)) for k in range(12)]
    for k in range(50):
        t = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"new{rng.randint(0, 3)}"
        texts.append(" ".join(t))
    texts += ["", None, "one", "ONE", "one two", " \n", "É", "é"]
    sets = [shingle_set(t, words) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = by_id(minhash.near_duplicates(documents(spark, *texts), words, percent))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), find(k), find(k) == k) for k in range(len(texts))}


def test_one_of_each(spark, odd):
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, k) for k in (1, 2, 3, 4, 5, 6, 7)] + [(True, 0)]


# --- 4: quality model -------------------------------------------------------------------------------------------


def kneser_ney(texts, order=quality_model.ORDER):
    """Log-chance of a byte after a context, straight from the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode()
        for i in range(order - 1, len(raw)):
            counts[order][raw[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    discounts = [None] + [quality_model.discounts(Counter(counts[n].values())) for n in range(1, order + 1)]
    cut = lambda n, c: discounts[n][min(c, 3) - 1]
    after = [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            total, less = after[n].get(g[:-1], (0, 0.0))
            after[n][g[:-1]] = total + c, less + cut(n, c)

    def chance(gram):
        p = 1 / 256
        for n in range(1, order + 1):
            g = gram[order - n :]
            if g[:-1] in after[n]:
                total, less = after[n][g[:-1]]
                c = counts[n].get(g, 0)
                p = (c - cut(n, c) if c else 0) / total + less / total * p
        return math.log(p)

    return chance


@pytest.mark.parametrize("sent_rows", [10**6, 150])
def test_perplexity_is_kneser_ney(spark, sent_rows):
    train = [prose(k, 30) for k in range(20)] + ["été à Noël"]
    chance = kneser_ney(train)
    scratch = quality_model.C.Scratch(spark, "test")
    model = quality_model.train(documents(spark, *train), scratch)
    texts = [prose(100, 20), "xyz ☃", "é", "", prose(3, 5)]
    rows = documents(spark, *texts).repartition(5, F.rand(3)).select("doc_id", "text")
    got = by_id(quality_model.scored(rows, model, scratch, sent_rows, hot_rows=2))
    for k, t in enumerate(texts):
        raw = b"\0\0\0\0" + t.encode()
        if t:
            want = -sum(chance(raw[i - 4 : i + 1]) for i in range(4, len(raw))) / len(t.encode())
            assert got[k].log_loss == pytest.approx(want, rel=1e-4)
        else:
            assert got[k].log_loss is None


def test_quality_model_keeps_prose_and_drops_noise(spark):
    rng = random.Random(9)
    noise = lambda: " ".join("".join(rng.choice("QXZ#%~0123") for _ in range(6)) for _ in range(50))
    texts = [prose(k, 80) for k in range(300)] + [noise() for _ in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(250)] + [(310, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_model.judged(documents(spark, *texts), labels))
    # by definition the threshold leaves out a twentieth of trusted text; noise is far beyond it
    assert sum(got[k].kept for k in range(300)) >= 300 * (quality_model.QUANTILE - 0.01)
    assert not any(got[k].kept for k in range(300, 320))


def test_quality_threshold_is_the_quantile_of_held_out_documents(spark):
    texts = [prose(k, 60 + k % 60) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = quality_model.judged(documents(spark, *texts), labels).where("pmod(xxhash64(doc_id, 4), 5) = 0").collect()
    dropped = sum(not r.kept for r in got) / len(got)
    assert 0.02 <= dropped <= 0.08


# --- 5: personal data -------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    text, out = text or "", []
    digits = lambda v: re.sub("[^0-9]", "", v)
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def pii_texts():
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = []
    for k in range(80):
        card = number(rng.randint(13, 18))
        card += next(d for d in "0123456789" if luhn(card + d))
        pieces = [
            prose(k, 5), "a.b@c.de", "x@y@z.com", "me@host", "a@b..c", "+.%@a-b.c.d.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00001.2.3.4", "1.2.3", card, "-".join(card[i : i + 4] for i in range(0, len(card), 4)),
            number(22), "+1 (555) 123-4567", "+44 20 7946 0958", "+123", "+1" + number(20), "😀+49 30 1234567.", "é" + card + "é", "9" * 400, "(555) 123-4567", "123-45-6789", "user [at] mail [dot] com", "DE89 3704 0044 0532 0130 00",
        ]
        made.append(rng.choice(["", " ", ", "]).join(rng.sample(pieces, rng.randint(1, 6))))
    return made


def test_pii_base_spans(spark):
    texts = pii_texts()
    got = by_id(pii.found(documents(spark, *texts)))
    for k, text in enumerate(texts):
        want, row = base_pii(text), got[k]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(x[1] == j for x in want) for j in range(4)), text
        joined = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_pii_reliabilities_rank_a_good_labeler_over_a_random_one():
    rng = random.Random(3)
    counts: Counter = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.5
        good = [(1 if truth else -1) if rng.random() < 0.9 else (-1 if truth else 1) for _ in range(4)]
        counts[(*good, rng.choice((-1, 1)))] += 1
    _, tables, _ = pii.reliabilities(dict(counts))
    assert tables[0][1][0] / tables[0][1][1] > 4
    assert tables[4][1][0] / tables[4][1][1] == pytest.approx(1, abs=0.2)


def test_pii_additions_are_right(spark):
    """Additions of planted loose spans: nine in ten are named by their context, and nine in ten of those are added."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    local = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4)}"
    mail = lambda: f"{prose(rng.random(), 1)[:-1]}{digits(2)} [at] example [dot] org"
    base = [f"{prose(k, 9)} call +49 30 {digits(8)} or a{k}@example.org {prose(k, 3)}" for k in range(60)]
    true = [f"{prose(k, 9)} {rng.choice(['phone: ', 'call '])}{local()} {prose(k, 3)}" for k in range(60)] + [f"{prose(k, 9)} e-mail {mail()} {prose(k, 3)}" for k in range(60)]
    decoys = [f"{prose(k, 9)} {rng.choice('1234567')}{digits(15)} {prose(k, 3)}" for k in range(60)] + [f"{prose(k, 9)} order 000-{digits(3)}-{digits(4)} {prose(k, 3)}" for k in range(60)]
    got = by_id(pii.found(documents(spark, *base, *true, *decoys)))
    right, wrong = sum(got[60 + k].n_added > 0 for k in range(120)), sum(got[180 + k].n_added > 0 for k in range(120))
    assert right >= 108 and right >= 9 * wrong


def test_pii_running_sums(spark):
    values = [random.Random(n).choices(range(50), k=n) for n in (0, 1, 2, 3, 10, 101)]
    rows = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", F.expr(pii._running("v", "sum")).alias("s"), F.expr(pii._running("v", "max")).alias("m")).collect()
    for r in rows:
        assert r.s == [sum(r.v[:k]) for k in range(len(r.v))] and r.m == [max(r.v[:k], default=0) for k in range(len(r.v))]


def test_pii_candidates_that_overlap_base_spans_are_left_out(spark):
    text = "pay 4111 1111 1111 1111 or 4111111111111112 now, +1 212 555 0100 and 212-555-0100, x@y.org 212-555-0101"
    spans = pii.spanned(documents(spark, text).select("doc_id", "text")).first()
    free = [(text[x.s : x.e], x.family) for x in spans.spans if not x.base]
    assert free == [("4111111111111112", "number"), ("212-555-0100", "local_phone"), ("212-555-0101", "local_phone")]
    assert [text[x.s : x.e] for x in spans.base] == ["4111 1111 1111 1111", "+1 212 555 0100", "x@y.org"]


def test_pii_plan_has_no_python(spark):
    plan = pii.found(documents(spark, "a@b.de"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 6: decontamination ------------------------------------------------------------------------------------------


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank at dawn today"
    edited = item.replace("brown", "red").replace("old ", "").replace("dawn", "early dawn")
    texts = [f"{prose(1)} {item} {prose(2)}", f"{prose(3)} {edited.upper()}, {prose(4)}", prose(5), None, "", "the quick brown fox", "exactly this"]
    bench = spark.createDataFrame([(1, item), (2, "exactly this"), (3, None), (4, ""), (1, item), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents(spark, *texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 2)}
    assert got[0, 1] == 1.0 and 0.7 < got[1, 1] < 1.0
    kept = decontaminate.clean_rows(documents(spark, *texts), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}


def test_leaks_of_edited_copies_equal_alignment_of_all(spark):
    """Against aligning every item with every whole text: edited, quoted and common passages, in a table of any size."""
    rng = random.Random(12)
    items = [prose(1000 + k, 40)[:-1] for k in range(8)]

    def edited(text, share):
        words = text.split()
        for k in range(len(words)):
            if rng.random() < share:
                words[k] = rng.choice(["", "edited", f"{words[k]} more"])
        return " ".join(words)

    texts = [f"{prose(k, 30)} {edited(items[k % 8], rng.choice([0, 0.1, 0.2, 0.3]))} {prose(k + 1, 30)}" for k in range(64)]
    half = " ".join(items[3].split()[:22])
    texts += [f"{prose(k, 20)} {half} {prose(k + 1, 20)}" for k in range(40)] + [prose(k, 80) for k in range(20)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents(spark, *texts), benchmark).collect()}
    code: dict = {}
    plain = lambda text: np.array([code.setdefault(w, len(code)) for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split()])
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            words = plain(item)
            score = decontaminate.align(words, plain(text))[0] / (2 * len(words))
            if score >= decontaminate.SCORE:
                want[d, i] = score
    assert len(want) > 90 and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert all(got[64 + k, 3] == want[64 + k, 3] for k in range(40))


def test_alignment_equals_the_textbook_recurrence():
    rng = random.Random(5)
    for _ in range(30):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 15))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(max(r) for r in h)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items = [prose(k, 30) for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, *(f"{prose(50 + k)} {t}" for k, t in enumerate(items)))
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole
    assert {(r[0], r[1]) for r in whole} >= {(k, k) for k in range(12)}


# --- 7: language ---------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = by_id(language.identified(docs))
    assert set(got) == set(truth)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.95


def test_language_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = language.Field(["a", "b", "c"])
    field.moves, field.starts = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(9, 3))
    fresh = np.zeros(9, bool)
    fresh[[0, 4, 5]] = True
    got = field.marginals(scores, fresh)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        total = np.zeros((b - a, 3))
        for path in np.ndindex(*(3,) * (b - a)):
            w = field.starts[path[0]] + sum(scores[a + t, y] for t, y in enumerate(path)) + sum(field.moves[x, y] for x, y in zip(path, path[1:], strict=False))
            for t, y in enumerate(path):
                total[t, y] += math.exp(w)
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True))


def test_language_of_switched_words_and_of_nothing(spark):
    en, de = "the house and the garden of this other town", "das haus und der garten von einer anderen stadt"
    texts = [en, de] * 40 + [f"{en} {de}", "12 34 !!", None, "", "漢字"]
    rows = [(k, t, ("en", "de")[k % 2] if k < 80 else None, None, None) for k, t in enumerate(texts)]
    got = by_id(language.identified(spark.createDataFrame(rows, SCHEMA)))
    assert [got[k].lang_pred for k in (81, 82, 83)] == ["und"] * 3 and got[84].lang_pred in ("en", "de")
    assert got[80].score < 0.8 < min(got[0].score, got[1].score)


# --- 8: main text of pages --------------------------------------------------------------------------------------------


def page(body, tail=""):
    return f"<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav>{body}<div class='sidebar'>Side</div><footer>Foot</footer></body></html>{tail}"


def test_pages(spark):
    rows = [
        (1, "http://a.com/1", page("<article><h1>A &amp; B</h1><p>One\n two<b>bold</b></p><div class='comments'>no</div><p>Three<br>four</p></article>")),
        (2, "http://a.com/2", page("<main><p>Only this.<aside>no</aside></p></main>")),
        (3, "http://b.com/1", page("<div class='content'><p>First page text that is its own.</p><form>no<input></form></div><div>Same words on all pages.</div>")),
        (4, "http://b.com/2", page("<div class='content'><p>Second page, other words.</p></div><div>Same words on all pages.</div>")),
        (5, None, "plain text &lt; kept"), (6, "x", None), (7, "", ""), (None, "http://a.com/1", "<p>unclosed <i>markup"), (8, "http://c.com", "<p>a</p>" * 3000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("template", F.lit("x"))
    got = {r.page_id: r.text for r in html_extract.extracted(pages).collect()}
    assert got[1] == "A & B One twobold Three four"
    assert got[2] == "Only this."
    assert got[3] == "First page text that is its own." and got[4] == "Second page, other words."
    assert (got[5], got[6], got[7], got[None]) == ("plain text < kept", "", "", "unclosed markup")
    assert got[8] == " ".join(["a"] * 3000)
    assert html_extract.extracted(pages.where("false")).count() == 0


def test_tree_matching_is_order_preserving_and_largest():
    a, b = html_extract.parse("<ul><li>1</li><p>2</p><li>3</li></ul>"), html_extract.parse("<ul><p>x</p><li>y</li></ul>")
    assert len(html_extract.match(a, b)) == 4  # root, list, and p before li


def test_each_layout_has_its_template(spark):
    def body(k, words):
        return f"<html><body><div class='content{k % 2}'><p>Text {words} of page {k}.</p></div><div class='end{k % 2}'>Layout {k % 2} says this.</div></body></html>"

    rows = [(k, f"http://a.com/{k}", body(k, f"w{k}")) for k in range(40)]
    rows += [(k, f"http://b.com/{k}", body(k, f"v{k} " + "<br>".join("x" for _ in range(2500)))) for k in (40, 42)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Text w{k} of page {k}." for k in range(40))
    assert not any("says this" in got[k] for k in (40, 42))


@pytest.mark.parametrize("sent", [2_000, 0])
def test_wrappers_find_articles_that_no_name_marks(spark, sent, monkeypatch):
    """Plain divisions without a telling element, class or link: what all pages of a host share goes, whatever its length."""
    monkeypatch.setattr(html_extract, "LAYOUTS_SENT", sent)
    long = prose(77, 60)
    page = lambda k: f"<html><body><div><p>Start</p><p>Goods and prices</p></div><div><h1>Story {k}</h1><p>{prose(k, 30)}</p><p>{prose(-k, 12)}</p></div><div><p>{long}</p><p>All rights reserved</p></div></body></html>"
    inner = lambda k: f"<html><body><article><p>{prose(500 + k, 20)}</p><p>{long}</p></article><div>x</div></body></html>"
    rows = [(k, f"http://plain.example/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://inner.example/{k}", inner(k)) for k in range(6)] + [(200 + k, f"http://two.example/{k}", inner(900 + k)) for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} {prose(k, 30)} {prose(-k, 12)}" for k in range(30))
    assert all(got[100 + k] == prose(500 + k, 20) for k in range(6))
    assert all(got[200 + k] == f"{prose(1400 + k, 20)} {long}" for k in range(2))


def test_long_lists_are_matched_like_short_ones():
    a, b = (html_extract.parse("<ul>" + kids + "</ul>") for kids in ("<li>1</li>" * 150 + "<p>x</p>", "<p>y</p>" + "<li>1</li>" * 150 + "<p>x</p>"))
    assert len(html_extract.match(a, b)) == 153  # root, list, and all of the shorter one


# --- 9: repeated strings -------------------------------------------------------------------------------------------------


def repeated_strings(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    for r in raw:
        mask = bytearray(len(r))
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                mask[i : i + 400] = b"\1" * 400
        runs = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        yield len(r), sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(r, mask, strict=True) if not m)).hexdigest()


@pytest.mark.parametrize(("bucket", "held", "cells"), [(2000, 20_000, 4_000_000), (4, 12, 60)])
def test_repeated_strings(spark, bucket, held, cells, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    monkeypatch.setattr(substrings, "HELD", held)
    monkeypatch.setattr(substrings, "CELLS", cells)
    rng = random.Random(bucket)
    shared = [prose(k, 150) for k in range(3)]
    texts = ["", None, "a" * 1000, "a" * 399, "ab" * 600, "é" * 350]
    for k in range(45):
        cut = rng.choice(shared)
        i = rng.randint(0, 300)
        texts.append(rng.choice([prose(k, 40), cut[i : i + rng.randint(300, 900)], prose(k, 20) + cut[i:] + prose(k + 1, 30), cut + cut, texts[-1] or ""]))
    got = by_id(substrings.removed(documents(spark, *texts)))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == list(repeated_strings(texts))


def edited_copies(n):
    rng, base = random.Random(n), prose(1, 160)
    for _ in range(n):
        text = list(base)
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice("0123456789")
        yield "".join(text)


def test_crowded_buckets_grow_in_proportion(spark, monkeypatch):
    """A context of near copies of one text becomes four rows at most, however many copies there are."""
    monkeypatch.setattr(substrings, "BUCKET", 20)
    split = substrings._split
    for n in (40, 160):
        made = []

        def counted(rows, made=made):
            made.append((rows.count(), split(rows).count()))
            return split(rows)

        monkeypatch.setattr(substrings, "_split", counted)
        texts = list(edited_copies(n))
        got = by_id(substrings.removed(documents(spark, *texts)))
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == list(repeated_strings(texts))
        assert made and sum(out for _, out in made) <= 4 * made[0][0]


def test_deep_shallow_order():
    rng = random.Random(2)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
        order, lcps = substrings.deep_shallow(texts)
        assert [texts[k] for k in order] == sorted(texts)
        for k in range(1, len(order)):
            a, b = texts[order[k - 1]], texts[order[k]]
            assert lcps[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# --- 10: quality rules -----------------------------------------------------------------------------------------------------


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_rule_counts(spark, labels):
    line = prose(4, 9)
    texts = ["", None, " ", "a b", "x # y\n\nx # y\n x # y", f"{line}\n{line}\n{line}", "é ü ß 漢 😀", "\n".join([line, "", " ", line]), *(f"{prose(k, 30)} {line} {prose(k + 1, 5)}\n{line}" for k in range(20)), "a\x0bb\x0cc\rd\te"]
    got = by_id(quality_rules.judged(documents(spark, *texts), labels.where("false")))
    for k, t in enumerate(texts):
        r = got[k]
        want = rule_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_rules_find_a_planted_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] <= 0.6)
    rules = quality_rules.learn(x, bad)
    held = np.zeros(900, bool)
    for rule in rules.rules:
        held |= quality_rules._held(x, [(list(quality_rules.FEATURES).index(n), o, t) for n, o, t in rule])
    assert (held == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(900, bool)).rules == []


# --- odd rows and registration ----------------------------------------------------------------------------------------------


def test_odd_rows(spark, odd, labels):
    bench = spark.createDataFrame([(1, prose(2)[:120]), (None, "x"), (2, None)], "item_id long, text string").withColumn("score", F.lit("x"))
    n = odd.count()
    path = packing.vocabulary_file()
    assert secrets.redacted(odd).count() == n
    assert packing.packed(odd, path).where("piece = 0").count() == n
    assert {r.doc_id for r in decontaminate.leaks(odd, bench).collect()} == {7, 8}
    for df in (quality_rules.kept_rows(odd, labels), decontaminate.clean_rows(odd, bench), secrets.redacted(odd)):
        assert df.columns == odd.columns
    clean = decontaminate.clean_rows(odd, bench).select("doc_id").collect()
    assert len(clean) == n - 2


def test_odd_rows_have_stated_values(spark, odd, labels):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows = lambda df, *names: sorted((tuple(r[c] for c in ("doc_id", *names)) for r in df.collect()), key=repr)
    assert rows(secrets.found(odd), "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans") == sorted(((i, 0, 0, 0, 0, EMPTY_SHA, "") for i, _ in texts), key=repr)
    assert rows(pii.found(odd), "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans") == sorted(((i, 0, 0, 0, 0, 0, EMPTY_SHA, "") for i, _ in texts), key=repr)
    near = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert near == {(1, False, 1, True), (2, False, 2, True), (3, False, 3, True), (4, True, 4, True), (5, True, 5, True), (None, True, None, True), (6, True, 6, True), (7, True, 7, True), (8, True, 7, False)}
    cut = zip(texts, repeated_strings([t for _, t in texts]), strict=True)
    assert rows(substrings.removed(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *x) for (i, _), x in cut), key=repr)
    counted = rows(quality_rules.judged(odd, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert counted == sorted(((i, *rule_counts(t)) for i, t in texts), key=repr)
    named = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(odd).collect()}
    assert all(named[k] == ("und", 0.0) for k in (1, 2, 3)) and named[4][0] != "und" and 0 <= named[4][1] <= 1
    rated = quality_model.judged(odd, labels).collect()
    judged = {r.doc_id: r for r in rated}
    assert len(rated) == len(texts) and not any(judged[k].kept or judged[k].perplexity is not None for k in (1, 2)) and judged[4].perplexity > 1
    pieces = packing.packed(odd, packing.vocabulary_file())
    assert sorted(((r.doc_id, r.start, r.length) for r in pieces.collect() if r.doc_id in (1, 2, 3))) == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]


def test_empty_tables(spark, odd, labels):
    none, no_labels = odd.where("false"), labels.where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        secrets.found(none), minhash.near_duplicates(none), quality_model.judged(none, no_labels), pii.found(none), language.identified(none), substrings.removed(none), quality_rules.judged(none, no_labels),
        packing.packed(none, packing.vocabulary_file()), decontaminate.leaks(none, bench), minhash.one_of_each(none), secrets.redacted(none), quality_rules.kept_rows(none, no_labels), decontaminate.clean_rows(none, bench),
    ):
        assert df.count() == 0
    assert decontaminate.clean_rows(odd, bench).count() == odd.count()


def test_registered():
    assert [k.split("_")[0] for k in registry.QUERIES if k.startswith("op")] == [f"op{n}" for n in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_span_hashes_are_of_content_alone():
    data = np.frombuffer(b"abc xabc abc", np.uint8)
    h = kernels.Spans(data).hash(np.array([0, 5, 9, 1]), np.array([3, 8, 12, 3]))
    assert h[0] == h[1] == h[2] != h[3]
