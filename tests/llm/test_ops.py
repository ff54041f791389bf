"""The ten operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from oracle import database, difference, duck_bag, spark_bag
from pyspark.sql import functions as F

from kestrane.llm import chat_format, fingerprints, langid, mixing, near_dedup, pll, quality_classifier, quality_rules, sharding, unigram
from kestrane.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names an operator might use."""
    long = "word " * 30_000 + "end"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, long, "en", "a", 9), (3, long, "en", "a", 9), (None, "no id here", "fr", "b", 1), (4, "▁ <0x0A> \\h ###  x\n\n…", "fr", "b", 2), (5, "12 34 ?!", "de", "c", 3)]
    return spark.createDataFrame(rows, DOC).withColumns({"slot": F.lit(1), "score": F.lit("s"), "id": F.lit(0), "rep": F.lit(2), "key": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, name):
    assert difference(spark_bag(Q.queries()[name](spark, SF)), duck_bag(database(SF), Q.oracle_sql()[name])) == ""


def test_rules_keep_clean_texts(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality_rules.keep_good(docs).join(labels, "doc_id").filter("quality = 1").count()
    assert kept >= 0.9 * docs.join(labels, "doc_id").filter("quality = 1").count()
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(none).isEmpty()
    long = next(r for r in quality_rules.judged(odd).collect() if r["doc_id"] == 3)
    assert long["_q_n_words"] == 30_001 and long["_q_n_repeat_words"] == 30_000
    assert quality_rules.judged(odd).filter("doc_id = 1").head()["_failed"][0] == "base"


def test_repeats_by_brute_force(spark):
    texts = ["a b c a b c", "a b", "x y z w x y z", "a a a a", "p q r s t"]

    def brute(t):
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["text"]: r["_q_n_repeat_words"] for r in quality_rules.measured(df).collect()} == {t: brute(t) for t in texts}


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be \\l kind"), (1, 1, "user", "### User: </turn> \\b"), (1, 2, "assistant", "a: b</turn>\n### "), (2, 0, "assistant", None), (3, 0, "odd: role\n", "x"), (None, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.formatted(df).withColumn("back", chat_format.parsed(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in (1, 2, 3, None):
        assert [tuple(x) for x in got[conv]["back"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["first_bad"] == 0 and got[1]["loss"] == rows[2][3] and got[3]["loss"] == ""


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op3_fingerprints(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, key in enumerate(order):
        t, after = texts[key], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[key]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t.encode()) and r["edited_fingerprint"] == fingerprints.fingerprint(edited.encode())
    far = [r["near_next"] for r in got.values() if r["n_chars"] > 400]
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 400]
    assert sum(near) / len(near) > 0.5 > 0.3 > sum(far) / len(far)
    assert fingerprints.fingerprinted(odd).count() == 7 and fingerprints.fingerprinted(none).isEmpty()
    pair = lambda k, t, nk, nt: (k, nk)
    many = fingerprints.with_next(docs, "doc_id", "text", "k long, n long", pair, rows_each=7)
    assert {r["k"]: r["n"] for r in many.collect()} == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    assert fingerprints.with_next(odd, "doc_id", "text", "k long, n long", pair).count() == 7


def test_successors_in_many_ranges(spark, odd, none, monkeypatch):
    """More ranges than cuts, with keys in lumps, far apart, negative and at the bounds of a long; ranges that don't fit a broadcast."""
    pair = lambda k, t, nk, nt: (k, t, nk, nt)
    keys = sorted({*range(-40, 200), *range(10**12, 10**12 + 90, 3), *(7**j for j in range(20)), -(1 << 63), (1 << 63) - 1})
    docs = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string").repartition(5)
    want = [(k, f"text {k}", n, f"text {n}") for k, n in zip(keys, [*keys[1:], keys[0]])]
    schema = "k long, t string, nk long, nt string"
    for cuts, most in ((1023, 2_000_000), (6, 2_000_000), (6, 0), (0, 2_000_000)):
        monkeypatch.setattr(fingerprints, "CUTS", cuts)
        monkeypatch.setattr(fingerprints, "BROADCAST_RANGES", most)
        got = fingerprints.with_next(docs, "doc_id", "text", schema, pair, rows_each=9)
        assert sorted(map(tuple, got.collect())) == want
        assert fingerprints.with_next(odd, "doc_id", "text", schema, pair, rows_each=2).count() == 7
        assert fingerprints.with_next(none, "doc_id", "text", schema, pair).isEmpty()
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 100)
    assert sorted(map(tuple, fingerprints.with_next(docs, "doc_id", "text", schema, pair).collect())) == want


def test_fingerprint_has_no_tail():
    """Every chunk of a text has its character, however many boundaries repeated text brings."""
    rolled = lambda t: fingerprints._rolling(np.frombuffer(t.encode(), np.uint8)).astype(np.int64)
    lines = "".join(f"page {i} of the item and line {i * 7919 % 1000} " for i in range(500))
    phrase = next(p for p in (f"qz{i} " for i in range(10_000)) if (rolled(p * 9)[7:] % 768 == 767).any())
    for t in (lines, phrase * 2000 + lines, lines + phrase * 2000, phrase * 2000):
        block, *signatures = fingerprints.fingerprint(t.encode()).split(":")
        for size, signature in zip((int(block), 2 * int(block)), signatures, strict=True):
            ends = np.flatnonzero(rolled(t) % size == size - 1)
            assert len(signature) == len({*ends.tolist(), len(t) - 1}) <= fingerprints.LENGTH


def test_sharding(spark, docs, odd):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 251)
    counts = [table.count(i) for i in range(7)]
    assert min(table) == 0 and max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 251)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.35 * 251
    assert sharding.placed(odd, "doc_id", names, prefix="_").columns == [*odd.columns, "_slot", "_shard"]
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 250)


def test_language(spark, odd, none):
    rows = Q.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [(r["lang_pred"], truth[r["doc_id"]]["lang"]) for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    letters = lambda t: bool(re.search(r"[^\W\d_]", t or ""))
    assert all((r["lang_pred"] == "und") == (not letters(truth[r["doc_id"]]["text"])) and 0 <= r["score"] <= 1 for r in rows)
    model = langid.train({"aa": {"abab": 5}, "bb": {"cdcd": 5}})
    got = {r["doc_id"]: r["_lang"] for r in langid.predicted(odd, model).collect()}
    assert got[1] == got[2] == got[5] == "und" and got[4] != "und"
    assert langid.predicted(odd, langid.fit(none)).filter("_lang <> 'und'").isEmpty()


def test_language_of_few_distinct_texts(spark):
    """A language with one text is learnt whatever its hash; one that is mostly copies of a text is learnt from its other texts, too."""
    many = [(f"der hund und die katze gehen nummer {chr(97 + i % 26) * 3} ins haus {chr(97 + i // 26) * 2}", "de") for i in range(60)]
    hot = [("same copy here", "en")] * 3000 + [(f"the quick brown fox jumps over lazy dogs {chr(97 + i % 26) * 3}", "en") for i in range(26)]
    single = [(f"{c}{c}zy {c}wxu", f"l{i}") for i, c in enumerate("abcdefghijkl")]
    df = spark.createDataFrame(many + hot + single, "text string, lang string")
    model = langid.fit(df, docs_per_language=40)
    assert model.languages == sorted({lang for _, lang in many + hot + single})
    got = {r["text"]: r["_lang"] for r in langid.predicted(df, model).collect()}
    assert all(got[t] == lang for t, lang in many + hot + single)


def test_classifier(spark, odd, none):
    rows = Q.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    up, down = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert auc >= 0.9 and sum((s >= 0.5) == (y == 1) for s, y in held) >= 0.85 * len(held)
    empty = quality_classifier.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r["_score"] <= 1 for r in quality_classifier.scored(odd, empty).collect())


def test_classifier_prior_is_of_its_own_input(spark):
    """Documents labelled 1 survive where nearly all of the input is good and where little is, whatever labels other documents have."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    good, bad = labels.filter("quality = 1"), labels.filter("quality = 0")
    few = good.filter(F.crc32(F.col("doc_id").cast("string")) % 20 == 0)
    away = spark.range(10**9, 10**9 + 20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    for own, others in ((good, bad.select("doc_id", "quality").union(away)), (few.union(bad), good.join(few, "doc_id", "left_anti"))):
        df = docs.join(own.select("doc_id"), "doc_id", "left_semi").persist()
        truth = {r["doc_id"]: r["quality"] for r in own.collect()}
        model = quality_classifier.fit(df, own.union(others))
        assert model.prior == pytest.approx(min(sum(truth.values()) / len(truth), 0.99), abs=0.15)
        kept = {r["doc_id"]: r["_score"] >= 0.5 for r in quality_classifier.scored(df, model).collect()}
        share = {y: sum(kept[k] for k in truth if truth[k] == y and k in kept) / max(1, sum(v == y for v in truth.values())) for y in (0, 1)}
        assert share[1] >= 0.9 and share[0] <= 0.1, share


def brute_components(texts, width, percent):
    sets = {}
    for k, t in texts.items():
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets[k] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            comp[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates(spark, docs, none):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = " ".join(f"w{i}" for i in range(60))
    more = {9001: None, 9002: "", 9003: "One two", 9004: "one  TWO", 9005: base, 9006: base + " extra", 9007: base + " extra more", 9008: base + " other end here", 9009: "É One", 9010: "é One"}
    texts |= more
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r["id"]: (r["n_shingles"], r["comp"]) for r in near_dedup.components(df, width=4).collect()}
    assert got == brute_components(texts, 4, 80)
    kept = near_dedup.keep_one(df.withColumn("comp", F.lit(1)), width=4)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in got.items() if k == c}
    assert near_dedup.keep_one(none).isEmpty()


@pytest.mark.parametrize(("first", "block"), [(0, 512), (0, 4), (4, 4), (32, 3)])
def test_blocks_find_every_pair(spark, monkeypatch, first, block):
    """Buckets that the first bands leave open are met in pairs of blocks, however large they are."""
    monkeypatch.setattr(near_dedup, "FIRST", first)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = {i: " ".join(f"c{j}" for j in range(40 - i % 3)) + "".join(f" d{i // 6}x{j}" for j in range(4 * (i // 6))) for i in range(36)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: (r["n_shingles"], r["comp"]) for r in near_dedup.components(df, width=4).collect()} == brute_components(texts, 4, 80)


def test_forests_stay_small():
    """A group of m members gives m - 1 links at most, however many pairs of it are similar."""
    texts = [" ".join(f"c{j}" for j in range(80) if j != i) for i in range(60)]
    sets = [near_dedup.shingles(t, 1) for t in texts]
    signatures = [near_dedup.signature(s) for s in sets]
    n = len(texts)
    rows = {"key": [0] * n, "x": [0] * n, "y": [0] * n, "side": [0] * n, "c": range(n), "n": [len(s) for s in sets], "id": range(n), "comp": range(n)}
    rows |= {"low": [(s >> np.uint32(12)).astype(np.uint8).tobytes() for s in signatures], "bands": [near_dedup._band_keys(s).tolist() for s in signatures], "elements": [s.tobytes() for s in sets]}
    members = near_dedup.Members(pa.table({k: list(v) for k, v in rows.items()}))
    p, q = members.pairs(0, n, 80, near_dedup.least_matches(0.8), once=False)
    assert len(p) > 1000 and len(list(members.forest(p, q, 80))) == n - 1


def test_near_duplicates_of_odd_ids(spark):
    """Text ids, null ids, repeated rows, and rows of one id with unlike texts, in any order."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [("1", one), ("2", two), ("3", one), ("3", two), ("4", three), ("4", three), (None, three), ("5", None), ("6", "")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("id", "comp", "rep", "c", "n", "t", "key", "a", "b")})
        got = {r["id"]: (r["n_shingles"], r["comp"]) for r in near_dedup.components(df, width=4).collect()}
        assert got == {"1": (57, "1"), "2": (57, "1"), "3": (57, "1"), "4": (57, "4"), "5": (0, "5"), "6": (0, "6")}
        kept = near_dedup.keep_one(df, width=4)
        assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({"1": 1, "4": 2, None: 1, "5": 1, "6": 1})


def test_near_duplicates_of_long_texts(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(60_000))
    texts = {1: long, 2: long + " end", 3: "start " + long, 4: long[: len(long) // 2]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["comp"] for r in near_dedup.components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicates_recall(spark):
    """The README's recall, against all pairs of a larger table whose sets are compared by an inverted index."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), width=4).collect()}
    sets, index = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        for s in sets[k]:
            index.setdefault(s, []).append(k)
    links = found = 0
    for k, s in sets.items():
        for other, both in Counter(o for x in s for o in index[x] if o > k).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                links += 1
                found += got[k] == got[other]
    assert links > 50 and found >= 0.99 * links


def test_sequential_test_keeps_similar_pairs():
    least = near_dedup.least_matches(0.8)
    assert (least[1:] >= least[:-1]).all() and least[-1] < 0.8 * near_dedup.HASHES


def test_stated_miss_rate():
    """The README's miss rate of a pair at the threshold, over all checkpoints and the bands."""
    p = 0.8 + 0.2 / 256
    batch = np.array([math.comb(near_dedup.BATCH, k) * p**k * (1 - p) ** (near_dedup.BATCH - k) for k in range(near_dedup.BATCH + 1)])
    left, missed = np.ones(1), (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS
    for least in near_dedup.least_matches(0.8).tolist():
        left = np.convolve(left, batch)
        missed += left[:least].sum()
        left[:least] = 0
    stated = re.search(r"missed with probability ([0-9.e-]+)", (Path(__file__).parents[2] / "README.md").read_text())
    assert stated and missed == pytest.approx(float(stated[1]), rel=0.05)


def test_language_model(spark, docs, odd, none):
    model = pll.fit(docs)
    rows = {r["doc_id"]: r for r in pll.scored(docs, model).collect()}
    text = next(r for r in docs.collect() if r["text"] and 100 < len(r["text"]) < 2000)
    codes, _ = pll.Coder(model.chars).windows([text["text"]])
    assert rows[text["doc_id"]]["_log_likelihood"] == pytest.approx(float(model.network.logs(codes).astype(float).sum()), rel=1e-4)
    mean = sum(r["_log_likelihood"] for r in rows.values()) / sum(r["_n_chars"] for r in rows.values())
    assert mean > -2.2  # all characters alike: -3.47
    out = {r["doc_id"]: r["_log_likelihood"] for r in pll.scored(odd, model).collect()}
    assert out[1] == out[2] == 0 and out[3] < 0
    assert pll.scored(none, pll.fit(none)).isEmpty()


def test_language_model_tells_all_characters_apart(spark, docs):
    """Digits, other scripts and symbols are scored as what they are, whatever characters are frequent in the corpus."""
    model = pll.fit(docs)
    own = next(r["text"] for r in docs.collect() if r["text"] and 100 < len(r["text"]) < 2000)
    texts = [own, own.upper(), "1234567", "7777777", "Жук", "Жар", "日本語", "日本人", "|||###", "###|||", "pvqxkj", "jkxqvp"]
    codes = [tuple(pll.Coder(model.chars).windows([t])[0].tolist()) for t in texts]
    assert len(set(codes)) == len(texts)
    rows = pll.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    score = {r["doc_id"]: r["_log_likelihood"] for r in rows}
    assert len(set(score.values())) == len(texts) and all(r["_n_chars"] == len(texts[r["doc_id"]]) for r in rows)
    per = {texts[r["doc_id"]]: r["_per_char"] for r in rows}
    assert all(per[t] < per[own] for t in texts[1:])


def test_language_model_trains_on_every_window(spark, docs, monkeypatch):
    seen, counts = {}, {11: 1, 12: 1000, 13: 1, 14: 2}

    def batch(self, codes, weight):
        for c, w in zip(codes.tolist(), weight.tolist(), strict=True):
            seen[c] = seen.get(c, 0) + w

    monkeypatch.setattr(pll.Trainer, "batch", batch)
    mean = sum(counts.values()) / len(counts)
    pll.Trainer(pll.Network.new(), 0.01, 1).learn(*(np.array(x) for x in (list(counts), list(counts.values()))), mean, 1)
    assert {c: w * mean for c, w in seen.items()} == pytest.approx(counts)
    gathered = {r["code"]: r["n"] for r in pll.window_counts(docs, "text", pll.alphabet(docs, "text"), most=50_000).collect()}
    assert sum(gathered.values()) == sum(len(r["text"] or "") for r in docs.collect())


def test_window_codes_by_hand():
    """Codes of texts in several runs, with characters of one to four bytes, against a program that goes token by token."""
    chars = np.array([ord(c) for c in "abc d"], np.int64)
    texts = ["", "abc", "é", "a日\U0001f600b", "", "ЖaЖ\x00", "\U0001f600" * 3, "cab dé " * 6000, "d" * 40_000, "b日"]
    expected, starts = [], [0]
    for t in texts:
        tokens = []  # (token, bytes that follow in its character)
        for c in t:
            some = [256 + list(chars).index(ord(c))] if ord(c) in chars else list(c.encode())
            tokens += [(x, len(some) - 1 - i) for i, x in enumerate(some)]
        for i, (token, left) in enumerate(tokens):
            near = [tokens[j][0] if 0 <= j < len(tokens) else pll.EDGE for j in range(i - 3, i + 4)]
            near[4 : 4 + left] = [pll.MASK] * left
            assert near[3] == token and len(near) == 7
            expected.append(sum(x << 9 * (6 - k) for k, x in enumerate(near)))
        starts.append(len(expected))
    codes, begin = pll.Coder(chars).windows(texts)
    assert codes.tolist() == expected and begin.tolist() == starts


def test_language_model_slope_by_differences():
    """A training batch's slope against differences of the loss, worked out plainly in double precision."""
    rng = np.random.default_rng(5)
    codes = sum(rng.choice([10, 70, 254, 255, 256, 280, 318, 319, 511], 40).astype(np.int64) << 9 * k for k in range(7))
    weight, net = rng.random(40).astype(np.float32), pll.Network.new()
    for a in net.arrays():
        a[:] = rng.standard_normal(a.shape) * 0.3
    trainer = pll.Trainer(net, 0.01, 1)
    trainer.batch(codes, weight)

    def loss(arrays):
        embed, inner, inner_bias, outer, outer_bias, rest, rest_bias = arrays
        total = 0.0
        for code, w in zip(codes.tolist(), weight.tolist(), strict=True):
            d = [code >> 9 * (6 - k) & 511 for k in range(7)]
            h = np.tanh(np.concatenate([embed[i][x] for i, x in enumerate(d[:3] + d[4:])]) @ inner + inner_bias)
            log = lambda z: z - np.log(np.exp(z).sum())
            first, second = log(h @ outer + outer_bias), log(h @ rest + rest_bias)
            head = 256 <= d[3] < 256 + pll.HEAD
            total -= w * (first[d[3] - 256] if head else first[pll.HEAD] + second[d[3] if d[3] < 256 else d[3] - pll.HEAD])
        return total / pll.SIZE

    arrays = [a.astype(np.float64) for a in net.arrays()]
    slopes = np.split(10 * trainer.m, np.cumsum([a.size for a in arrays])[:-1])  # after one batch the first moment is a tenth of the slope
    for a, slope in zip(arrays, slopes, strict=True):
        for place in [np.abs(slope).argmax(), *rng.integers(0, a.size, 3)]:
            own, got = a.flat[place], []
            for e in (1e-5, -1e-5):
                a.flat[place] = own + e
                got.append(loss(arrays))
            a.flat[place] = own
            assert slope[place] == pytest.approx((got[0] - got[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_language_model_uses_its_memory_again(spark):
    """Once warm, a task that scores 131,072 windows and trains on 32,768 needs few fresh pages: they cost more than the arithmetic."""

    def run(batches):
        import resource

        list(batches)
        rng = np.random.default_rng(1)
        codes = sum(rng.integers(256, 256 + pll.HEAD, 1 << 17) << 9 * k for k in range(7))
        scorer, trainer = pll.Known(pll.Network.new()).network, pll.Trainer(pll.Network.new(), 0.01, 1)
        for _ in range(2):
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            scorer.logs(codes)
            trainer.learn(codes[: 1 << 15], np.ones(1 << 15, np.int64), 1.0, 1)
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before])], names=["n"])

    faults = spark.range(1).mapInArrow(pll.lean(run), "n long").head()["n"]
    assert faults < 5000


def test_classifier_risk_by_hand():
    """The prior of known mixtures; and one training step against the risk's gradient by finite differences."""
    rng = np.random.default_rng(1)
    good, bad = (np.eye(quality_classifier.WIDTH)[rng.integers(k, k + 40, (4000, 8))].mean(1) for k in (0, 30))
    for true in (0.2, 0.5, 0.9):
        n = int(2000 * true)
        got = quality_classifier.estimated_prior(good[:2000], np.concatenate([good[2000 : 2000 + n], bad[: 2000 - n]]))
        assert true - 0.05 <= got <= true + 0.15
    p, u, prior, scale = good[:9], np.concatenate([good[9:14], bad[:6]]), 0.4, np.sqrt(quality_classifier.WIDTH) / 4

    def risk(w):
        loss = lambda z: np.log1p(np.exp(-z))
        fp, fu = p @ w[:-1] * scale + w[-1], u @ w[:-1] * scale + w[-1]
        return prior * loss(fp).mean() + max(0.0, loss(-fu).mean() - prior * loss(-fp).mean())

    begin = np.r_[np.zeros(quality_classifier.WIDTH), np.log(prior / (1 - prior))]
    slope = np.array([(risk(begin + 1e-6 * e) - risk(begin - 1e-6 * e)) / 2e-6 for e in np.eye(len(begin))])
    one = quality_classifier.train(p, u, prior, epochs=1, rate=1e-3, decay=0.0)
    moved = np.r_[one.weights / scale, one.bias] - begin
    clear = np.abs(slope) > 1e-5  # Adam's first step is the sign of the slope
    assert clear.sum() > 30 and (np.sign(moved[clear]) == -np.sign(slope[clear])).all() and np.abs(moved[clear]) == pytest.approx(1e-3, rel=1e-2)


def test_kneser_ney_by_dictionaries():
    """Probabilities of two small models against a second program that works on dictionaries of strings."""
    counts = {"aa": {"abra": 3, "cadabra": 2, "bar": 1, "ab": 1}, "bb": {"dada": 2, "bad": 1, "cab": 4}}
    order = 3
    size = len({c for words in counts.values() for w in words for c in w}) + 2

    def model(words):
        tables = {}
        grams = Counter()
        for w, n in words.items():
            t = "^" + w + "$"
            for i in range(1, len(t)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        grams[t[i - k + 1 : i + 1]] += n
        for k in range(1, order + 1):
            if k == order:
                tables[k] = {g: float(n) for g, n in grams.items() if len(g) == k}
            else:
                before = Counter(g[1:] for g in grams if len(g) == k + 1)
                tables[k] = {g: float(grams[g] if g[0] == "^" else before[g]) for g in grams if len(g) == k}
        return tables

    def log(tables, word):
        t, total = "^" + word + "$", 0.0
        for i in range(1, len(t)):
            p = 1.0 / size
            for k in range(1, min(order, i + 1) + 1):
                g, context = t[i - k + 1 : i + 1], t[i - k + 1 : i]
                c = tables[k]
                ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                same = {x: v for x, v in c.items() if x[:-1] == context}
                if same:
                    p = max(c.get(g, 0.0) - d, 0.0) / sum(same.values()) + d * len(same) / sum(same.values()) * p
            total += math.log(p)
        return total

    m = langid.train(counts, order)
    words = ["abra", "dad", "zzz", "cab", "barb"]
    got = m.logs(words)
    for j, lang in enumerate(m.languages):
        tables = model(counts[lang])
        for i, w in enumerate(words):
            assert got[i, j] == pytest.approx(log(tables, w), rel=1e-6), (lang, w)


def test_mixing(spark, docs, odd, none):
    out = mixing.mixed(docs, fraction=0.5).select("_mix.*").toPandas()
    expected = (out["n_tokens"] * out["probability"]).sum()
    assert expected == pytest.approx(0.5 * out["n_tokens"].sum(), rel=1e-6)
    for targets in (None, {"source": {"zzz": 1.0}}, {"source": {"src0": 3.0, "src1": 1.0}}):
        far, near = ({tuple(r[:-1]): r[-1] for r in mixing.mixed(docs, targets=targets, max_cells=cells, sweeps=3).select("doc_id", "_mix.probability").collect()} for cells in (0, 10**6))
        assert far.keys() == near.keys() and all(far[k] == pytest.approx(near[k], abs=1e-6) for k in near)
        assert sum(near.values()) > 0
    share = mixing.rake(out.groupby(["source", "lang"], as_index=False)["n_tokens"].sum(), ["source"], {"source": {"src0": 1.0}})
    assert share.sum() == pytest.approx(1.0)
    assert mixing.sample(odd).columns == odd.columns and mixing.sample(none).isEmpty()
    twice = mixing.mixed(odd.unionByName(odd)).groupBy("doc_id").agg(F.countDistinct("_mix.sampled").alias("n"))
    assert twice.filter("n > 1").isEmpty()


def test_raking_by_hand():
    """A table small enough to rake on paper, and one against a plain loop."""
    cells = pd.DataFrame({"a": ["x", "x", "y", "y"], "b": ["p", "q", "p", "q"], "n_tokens": [40, 30, 20, 10]})
    got = mixing.rake(cells, ["a", "b"], {"a": {"x": 0.5, "y": 0.5}, "b": {"p": 0.5, "q": 0.5}})
    # odds ratio 40 * 10 / (30 * 20) = 2 / 3 stays; both marginals are halves
    t = math.sqrt(2 / 3) / (1 + math.sqrt(2 / 3)) / 2
    assert got == pytest.approx([t, 0.5 - t, 0.5 - t, t], abs=1e-8)
    x = np.array([[5.0, 1.0, 0.0], [2.0, 2.0, 8.0]])
    rows, cols = [0.3, 0.7], [0.2, 0.3, 0.5]
    flat = pd.DataFrame([(f"r{i}", f"c{j}", x[i, j]) for i in range(2) for j in range(3)], columns=["a", "b", "n_tokens"])
    got = mixing.rake(flat, ["a", "b"], {"a": dict(zip(["r0", "r1"], rows, strict=True)), "b": dict(zip(["c0", "c1", "c2"], cols, strict=True))}).reshape(2, 3)
    y = x / x.sum()
    for _ in range(50):
        y = y * (np.array(rows) / y.sum(1))[:, None]
        y = y * (np.array(cols) / y.sum(0))[None]
    assert got == pytest.approx(y, abs=1e-8)
    p = mixing.probabilities(np.array([0.6, 0.4]), np.array([10.0, 90.0]), 50.0)
    assert p == pytest.approx([1.0, 40 / 90])


USED = {
    "quality_rules": ["_t", "_w", "_l", "_k", "_h", "_s", "_x", "_row", "_failed", "_q_n_words", "_Q_N_LINES"],
    "fingerprints": ["fingerprint", "Fingerprint_"],
    "sharding": ["slot", "shard", "_table_slot", "_table_shard"],
    "langid": ["_lang", "_score", "_entropy", "_rejected"],
    "quality_classifier": ["_score", "_id", "_one", "_u", "t", "one", "u"],
    "near_dedup": ["id", "t", "n", "digest", "low", "bands", "c", "rep", "comp", "key", "blocks", "side", "a", "b"],
    "pll": ["_n_chars", "_log_likelihood", "_per_char", "t", "code"],
    "mixing": ["_source", "_lang", "_topic", "_n", "_weight", "_p", "_mix", "n_tokens", "share"],
    "unigram": ["_ids", "_decoded"],
}


@pytest.mark.parametrize("name", list(USED))
def test_names_that_clash(spark, name):
    """Columns of the input that are called like an operator's own stay as they are; repeated rows, ties and nulls are judged alike."""
    rows = [(1, "The cat and the dog went to the house of the old man. " * 8, "en", "a", 0), (1, "The cat and the dog went to the house of the old man. " * 8, "en", "a", 0), (None, "le chat et le chien " * 20, "fr", "b", 1), (2, None, None, None, None), (3, "", "de", "c", 2)]
    plain = spark.createDataFrame(rows, DOC)
    df = plain.withColumns({c: F.lit(f"own {c}") for c in USED[name]})
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    work = {
        "quality_rules": lambda x: (quality_rules.judged(x), quality_rules.keep_good(x)),
        "fingerprints": lambda x: (fingerprints.fingerprinted(x), None),
        "sharding": lambda x: (sharding.placed(x, "doc_id", ["p", "q"], 251), None),
        "langid": lambda x: (langid.predicted(x, langid.fit(x)), None),
        "quality_classifier": lambda x: (quality_classifier.scored(x, quality_classifier.fit(x, labels)), None),
        "near_dedup": lambda x: (near_dedup.keep_one(x), near_dedup.keep_one(x)),
        "pll": lambda x: (pll.scored(x, pll.fit(x)), None),
        "mixing": lambda x: (mixing.mixed(x), mixing.sample(x)),
        "unigram": lambda x: (unigram.encoded(x, unigram.load(spark, Q.PIECES)), None),
    }[name]
    got, kept = work(df)
    expected, expected_kept = work(plain)
    assert got.columns[: len(df.columns)] == df.columns and len(got.columns) - len(df.columns) == len(expected.columns) - len(plain.columns)
    bag = lambda x, cols: sorted(repr([r[i] for i in cols]) for r in x.collect())
    n, width = len(plain.columns), len(df.columns)
    assert bag(got, [*range(n), *range(width, len(got.columns))]) == bag(expected, range(len(expected.columns)))
    assert all(r[n + i] == f"own {c}" for r in got.collect() for i, c in enumerate(USED[name]))
    if kept is not None:
        assert kept.columns == df.columns and bag(kept, range(n)) == bag(expected_kept, range(n))


def test_pieces(spark, docs, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    e = unigram.load(spark, Q.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
    for t in ["", " ", "a", "hello  world", "naïve ▁ mark", "日本語 \U0001f600 text", "x\n\ty  ", "▁▁", "a" * 300]:
        assert e.decode(e.encode(t)) == t
        assert sp.id_to_piece(0) == "<unk>" and all(0 < i < sp.get_piece_size() for i in e.encode(t))
    rows = unigram.encoded(docs.select("doc_id", "text"), e).collect()
    assert all(r["_decoded"] == (r["text"] or "") for r in rows)
    assert all(r["_decoded"] == (r["text"] or "") for r in unigram.encoded(odd, e).collect())

    def brute(part):
        best = {0: (0.0, [])}
        ids = {p: i for i, p in enumerate(e.pieces)}
        for j in range(1, len(part) + 1):
            for i in range(max(0, j - e.longest), j):
                k = ids.get(part[i:j])
                if k is not None and e.scores[k] > float("-inf") and i in best:
                    s = best[i][0] + e.scores[k]
                    if j not in best or s > best[j][0] + 1e-12:
                        best[j] = (s, [*best[i][1], k])
        return best[len(part)]

    for word in ("the", "international", "zwanzigste", "qqqq"):
        got = e.encode(word)
        assert sum(e.scores[got]) == pytest.approx(brute(unigram._MARK + word.encode())[0])


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == docs.columns and 0 < now.count() <= before, name
        before = now.count()
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == before and last.filter("NOT round_trip").isEmpty()
    kept = {r["doc_id"] for r in now.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    assert all(k == c for k, (_, c) in brute_components(texts, 5, 80).items())
