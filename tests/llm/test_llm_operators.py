import hashlib
import math
import os
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeparity.llm import decontaminate, fingerprints, html_text, language, licenses, mixing, registry, sharding, toxicity, url_filters, words

DATA = "/root/testdata/sf0.001"
HOSTILE = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "é" * 5000 + " x " * 3000, "b"), (5, "same text here", "b"), (5, "same text here", "b"), (6, "same text here", None), (None, "no id", "c")]


@pytest.fixture
def hostile(spark):
    return spark.createDataFrame(HOSTILE, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "score": F.lit("clash"), "shard": F.lit("x"), "fingerprint": F.lit("y"), "n_words": F.lit("z"), "lang": F.lit("en")})


#: Names that operators use inside, in one case or another, and some that SQL could misread.
NAMES = ["sk", "SK", "key", "_key", "range", "_range", "id", "row", "value", "rank", "curve", "_curve", "at", "part", "start", "before", "w", "_w", "s", "r", "c", "c0", "C1", "host", "fetched", "domain", "_h", "_source", "lang_code", "Budget", "ahead", "within", "x", "xx", "a.b", "a`b", "spans", "total", "hits", "html", "path", "blocks", "n", "found", "text_key", "crc", "grp", "p"]


def crowded(df, *taken):
    """``df`` with a column of every such name, and the names."""
    have, names = {c.lower() for c in [*df.columns, *taken]}, []
    for n in NAMES:
        if n.lower() not in have:
            have.add(n.lower())
            names.append(n)
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]), names


@pytest.mark.parametrize("name", ["url", "toxicity", "mixing", "fingerprints", "hits", "removal", "shards", "html", "licenses", "language", "mixed"])
def test_columns_of_any_name_are_kept(spark, name):
    docs = spark.createDataFrame([(i, f"some text {i} of a few words", "ab"[i % 2], "en") for i in range(6)], "doc_id long, text string, source string, lang string")
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", "<p>x</p>", "2024-01-01") for i in range(6)], "page_id long, url string, html string, day string")
    added = {
        "url": lambda d: url_filters.filter_urls(d.withColumn("day", F.col("day").cast("date")), url_filters.demo_entries(d), fetched_col="day"),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Model({" some ": 1.0}, [], [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])),
        "mixing": mixing.mix_sources,
        "fingerprints": fingerprints.fingerprint_documents,
        "hits": lambda d: decontaminate.find_hits(spark, d, docs.limit(1).withColumnRenamed("doc_id", "item_id")),
        "removal": lambda d: decontaminate.remove_hits(spark, d, docs.where("false").withColumnRenamed("doc_id", "item_id")),
        "shards": lambda d: sharding.hilbert_shards(spark, d),
        "html": lambda d: html_text.extract_text(spark, d),
        "licenses": licenses.scan_licenses,
        "language": lambda d: language.identify_language(spark, d),
        "mixed": lambda d: mixing.mixed_rows(d.withColumns({"size": F.lit(6), "taken": F.lit(6)})),
    }[name]
    taken = {"url": ["host", "domain", "list", "action", "blocked"], "toxicity": ["total", "often", "hits", "n_words", "score"], "hits": ["n_words", "spans", "items"], "html": ["text"], "licenses": ["n_words", "found"]}.get(name, [])
    df, names = crowded(pages if name in ("url", "html") else docs, *taken)
    rows = added(df).collect()
    assert len(rows) == 6
    assert all([r[n] for n in names] == list(range(len(names))) for r in map(lambda r: r.asDict(), rows))


def none_of(df):
    return df.where("false")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA), c.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted(repr([plain(r[k]) for k in want.columns]) for r in got.collect())
    assert a == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


# 2: URL filters.


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame(
        [("bad.com", "l", "block", "2024-01-10"), ("bad.com", "l", "remove", "2024-02-01"), ("bad.com", "l", "block", "2024-03-01"), ("ok.bad.com", "l", "allow", "2024-01-01"), ("twice.com", "l", "remove", "2024-01-05"), ("twice.com", "l", "block", "2024-01-05"), (None, "l", "block", "2024-01-01"), ("x.com", "l", "block", None)],
        "domain string, list string, action string, listed_on string",
    ).withColumn("listed_on", F.col("listed_on").cast("date"))
    asked = {("http://bad.com/a", "2024-01-09"): False, ("http://bad.com/a", "2024-01-10"): True, ("https://u:p@WWW.Bad.com:80/a", "2024-01-31"): True, ("http://bad.com", "2024-02-01"): False, ("http://bad.com", "2024-12-01"): True, ("http://ok.bad.com/", "2024-01-15"): False, ("http://notbad.com/", "2024-01-15"): False, ("http://twice.com/", "2024-01-05"): False, ("bad.com", "2024-01-15"): False, (None, "2024-01-15"): False, ("http://bad.com/", None): False, ("http://x.com", "2024-01-15"): False}
    df = spark.createDataFrame([(u, d) for u, d in asked] * 2, "url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date")).withColumn("blocked", F.lit("clash"))
    got = url_filters.filter_urls(df, entries).collect()
    assert len(got) == 2 * len(asked)
    for r in got:
        assert r["blocked"] == asked[r["url"], str(r["fetched_on"]) if r["fetched_on"] else None], r
    assert none_of(url_filters.filter_urls(none_of(df), entries)).count() == 0
    assert not url_filters.filter_urls(df, none_of(entries)).where("blocked").count()


# 3: toxicity.


def test_folding():
    assert toxicity.fold("1D10T, ідіοt! ＩＤＩＯＴ i​d́iot l0ser p@th3t!c x$$$".encode()).split() == ["idiot", "idiot", "idiot", "idiot", "ioser", "pathetic", "x"]
    assert toxicity.fold(b"") == " " and toxicity.fold(b"...") == " "


def test_lexicon_counts_and_exceptions():
    entries = {" trash ": 2.0, " mor": 1.0, " moron ": 3.0, " moro": 9.0}
    lexicon = toxicity.Lexicon(entries, [" trash can "], frozenset([" moro"]))
    assert lexicon.features(toxicity.fold(b"trash moron, trash can morons trashy")) == (2.0 + 3.0 + 1.0, 0.0, 3, 6)
    assert toxicity.Lexicon(entries, [], frozenset([" mor", " moro"])).features(" morons moros morons trash trash trash ") == (2.0 * 3, 9.0 * math.log2(3) + 9.0, 6, 6)
    assert toxicity.Lexicon({}, []).features(" a b ") == (0.0, 0.0, 0, 2)


def test_entries_that_clean_documents_have_now_and_then(spark):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        w = ["".join(r.choice("aeiou") + r.choice("bdf") for _ in range(3)) for _ in range(40)]
        for _ in range(4 if i % 5 == 0 else r.random() < 0.3):
            w[r.randrange(40)] = "zorp" + r.choice("aeiou") + r.choice("bdfgklm")
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " zorp" in model.often
    got = {x["doc_id"]: x["score"] >= 0.7 for x in toxicity.score_toxicity(d, model).collect()}
    assert sum(got[i] == bool(y) for i, y in labels) / len(labels) > 0.97


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["stupid", "MORON!", "id1ot", "vermilionx", "vermilionq"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(9001, None), (9002, ""), (9003, "ＳＴＵＰＩＤ ѕtupid mor0n")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.op3_query(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(docs)
    for i, _, y in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == y
    assert got[9003]["predicted"] == 1 and got[9001]["score"] == got[9002]["score"] < 0.5


def test_toxicity_without_labels(spark, hostile):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, hostile, none)
    got = toxicity.score_toxicity(hostile, model).collect()
    assert len(got) == len(HOSTILE) and all(0 <= r["score"] <= 1 for r in got)


def brute_score(model, text):
    """Every entry looked for at every place of the folded text."""
    folded, at, free = toxicity.fold((text or "").encode()), {}, []
    for term, weight in model.weights.items():
        for i in range(len(folded)):
            if folded.startswith(term, i):
                at[i] = max((term not in model.often, weight), at.get(i, (False, 0.0)))
    for phrase in model.exceptions:
        free += [(i, i + len(phrase) - 1) for i in range(len(folded)) if folded.startswith(phrase, i)]
    at = {i: w for i, w in at.items() if not any(a <= i < b for a, b in free)}
    word = lambda i: folded[i : folded.index(" ", i + 1)]
    told = {w: sum(word(j) == w for j in at) for w in {word(i) for i in at}}
    weight = {word(i): x for i, x in at.items()}
    total, often = (sum(weight[w][1] * (k if sure else math.log2(1 + k)) for w, k in told.items() if weight[w][0] == sure) for sure in (True, False))
    x = sum(b * v for b, v in zip(model.beta, toxicity.inputs(total, often, len(at), len(folded.split())), strict=True))
    return 1 / (1 + math.exp(-x))


@pytest.mark.parametrize("kind", ["int", "long", "boolean", "double"])
def test_scores_equal_brute_force_with_labels_of_any_type(spark, kind):
    r = random.Random(3)
    text = lambda toxic: " ".join(r.choice(["vile", "VILE!", "v1leness", "vile weather", "x", "y", "𠀋", "\U00030000z"] if toxic else ["fine", "weather", "x", "y"]) for _ in range(30))
    rows = [(i, text(i % 3 == 0)) for i in range(200)] + [(5, "again"), (None, "vile"), (303, "vile weather vile x"), (301, None), (302, "vile " * 100_000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(4, None), (6, 0), (None, 1)], "doc_id long, toxic int").withColumn("toxic", F.col("toxic").cast(kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"TOTAL": F.lit("clash"), "_0": F.lit(1), "a.b": F.lit(2)})
    model = toxicity.learn(spark, docs, labels, exceptions=("vile weather",))
    assert model.weights and model.exceptions
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and {"_0", "a.b", "score"} <= set(got[0].asDict())
    for x in got:
        if len(x["text"] or "") < 10_000:
            assert abs(x["score"] - brute_score(model, x["text"])) < 1e-9
        else:
            assert x["score"] > 0.9
    assert toxicity.score_toxicity(none_of(docs), model).count() == 0
    assert toxicity.op3_query(spark, docs, labels).where("doc_id is null").first()["held_out"]


# 4: mixing.


def test_mixing_meets_its_targets(spark, hostile):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 8 + ["b", "c", None]), " ".join(["w"] * r.randrange(0, 40))) for i in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    total = sum(x["size"] for x in got)
    by = {}
    for x in got:
        s = by.setdefault(x["source"], [0, x["source_size"], x["target"], 0])
        s[0] += x["taken"]
        s[3] += x["size"]
        assert 0 <= x["taken"] <= 3 * x["size"]
    assert abs(sum(v[2] for v in by.values()) - total) < 1e-6
    for taken, size, target, sizes in by.values():
        assert size == sizes and target <= 3 * size + 1e-9 and taken == round(target)
    want, left, weights = {}, float(total), dict(zip(sorted(k for k in by if k) + [None], [1, 2, 3, 1], strict=True))
    while True:  # the excess shared again until none is above
        free = {k: w for k, w in weights.items() if k not in want}
        level = left / sum(free.values()) if free else 0
        over = [k for k, w in free.items() if w * level >= 3 * by[k][1]]
        if not over:
            break
        for k in over:
            want[k] = 3.0 * by[k][1]
            left -= want[k]
    for k, v in by.items():
        assert abs(v[2] - want.get(k, weights[k] * level)) < 1e-6
    again = mixing.mix_sources(hostile)
    assert again.count() == len(HOSTILE) and sum(x["taken"] for x in again.collect()) > 0
    assert none_of(hostile).transform(mixing.mix_sources).count() == 0
    assert mixing.mix_sources(hostile.where("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0


def test_mixed_rows_have_the_words(spark):
    df = spark.createDataFrame([(1, " a  b\nc d ", 4, 10), (2, "a b", 2, 0), (3, "x y", 2, 2), (4, "p q r", 3, 1)], "doc_id long, text string, size long, taken long")
    got = sorted((x["doc_id"], x["text"].strip()) for x in mixing.mixed_rows(df).collect())
    assert got == [(1, "a  b"), (1, "a  b\nc d"), (1, "a  b\nc d"), (3, "x y"), (4, "p")]


# 5: fingerprints.


def brute_signature(text):
    minhash = words.MinHash(fingerprints.HASHES, seed=29)
    shingles = [int(h) for x in words.sets([text.encode()]) for h in x]
    return [min(((int(a) * h + int(b)) % (1 << 64) >> 32 for h in shingles), default=0xFFFFFFFF) & 0xFFFF for a, b in zip(minhash.a, minhash.b, strict=True)]


def spread_ids():
    """Ids beyond 2**53, negative ones, and one that a third of the rows have."""
    return [*(2**60 + 1237 * i + 1 for i in range(120)), *(-(2**62) + 3 * i for i in range(60)), *range(1, 40), *[2**61 + 5] * 100, None, None]


@pytest.mark.parametrize("ids", [[i * 3 for i in range(200)] + [30, 31], spread_ids(), [None] * 40, [7] * 40 + [9]])
def test_edited_likeness(spark, hostile, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 1000)
    r = random.Random(8)
    rows = [(i, "".join(r.choice("abc dé\n") for _ in range(r.choice([0, 3, 50, 700])))) for i in ids] + [(ids[-1], None)]
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].encode())))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.edited_likeness(spark, df).collect()
    want, prints = [], {}
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        for x in (t, edited, follow):
            if x not in prints:
                prints[x] = brute_signature(x)
        like = lambda a, b: sum(x == y for x, y in zip(prints[a], prints[b], strict=True)) / fingerprints.HASHES
        hexed = lambda a: "".join(f"{v:04x}" for v in prints[a])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(t), hexed(edited), like(t, edited), like(t, follow)))
    mine = [tuple(x[k] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for x in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_fingerprints_of_hostile_rows(spark, hostile):
    assert fingerprints.edited_likeness(spark, hostile).count() == fingerprints.op5_query(spark, hostile).count() == len(HOSTILE)
    assert fingerprints.op5_query(spark, none_of(hostile)).count() == 0
    one = fingerprints.edited_likeness(spark, spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one["n_chars"] == 7 and one["near_next"] == 1.0


def test_fingerprints_estimate_and_classes(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:390] + ["x"] * 10), " ".join(f"v{i}" for i in range(400)), "", " ".join(base), None]
    s = fingerprints.signatures([(t or "").encode() for t in texts])
    sets = list(words.sets([(t or "").encode() for t in texts]))
    real = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs(fingerprints.likeness(s[:1], s[1:2])[0] - real) < 0.1 and fingerprints.likeness(s[:1], s[2:3])[0] < 0.05
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)] + [(None, " ".join(base))], "doc_id long, text string")
    got = fingerprints.op5_query(spark, df).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=repr) == [(10, 10), (11, 10), (12, 12), (13, 13), (14, 10), (15, 15), (None, 10)]


@pytest.mark.parametrize("block", [512, 16])
def test_classes_of_copies_that_meet_only_through_the_largest_id(spark, monkeypatch, block):
    from treeparity.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = {1000: base, 2000: [f"v{i}" for i in range(50)]}
    for i in range(100):
        spots = {40 * k + r.randrange(36) for k in range(9)}
        texts[i] = [f"e{i}x{j}" if j in spots else w for j, w in enumerate(base)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(i, 1000) >= 0.75 for i in range(100)) and all(alike(i, j) < 0.75 for i in range(100) for j in range(i))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = sorted(tuple(x) for x in fingerprints.op5_query(spark, df).select("doc_id", "class_id").collect())
    assert got == [*((i, 0) for i in range(100)), (1000, 0), (2000, 2000)]


def test_classes_join_almost_all_pairs_at_the_threshold(spark):
    r, rows, n = random.Random(12), [], 400
    for i in range(n):  # 95 shingles in common of 126: 0.754
        w = [f"p{i}w{k}" for k in range(115)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-16], *(f"q{i}w{k}" for k in range(15))]))]
    sets = [set(x.tolist()) for x in words.sets([t.encode() for _, t in rows[:2]])]
    assert 0.75 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.76
    r.shuffle(rows)
    got = fingerprints.op5_query(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    joined = sum(x["doc_id"] % 2 == 1 and x["class_id"] == x["doc_id"] - 1 for x in got)
    assert joined >= 0.98 * n and all(x["class_id"] // 2 == x["doc_id"] // 2 for x in got)


# 6: decontamination.


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_decontamination_equals_brute_force(spark, hostile, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 9, 10, 14])))) for i in range(12)] + [(12, None), (3, "W1 w2-w3"), (None, "nul l")]
    docs = [(i, "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n"]) for _ in range(r.randrange(0, 60)))) for i in range(60)]
    for i in range(10):
        docs.append((100 + i, "head " + (items[r.randrange(12)][1] or "") .upper() + "; tail"))
    docs += [(200, None), (201, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(docs, [("" if i is None else i, t) for i, t in items])
    got = {x[0]: tuple(x[1:]) for x in decontaminate.op6_query(spark, d, b).collect()}
    assert got == want
    kept = {x["doc_id"] for x in decontaminate.remove_hits(spark, d, b).collect()}
    assert kept == {i for i, w in want.items() if not w[4]}
    cut = {x["doc_id"]: x["text"] for x in decontaminate.remove_hits(spark, d, b, remove="spans").collect()}
    again = decontaminate.find_hits(spark, d, b).collect()
    assert len(cut) == len(again) and all(cut[i] == t for i, t in docs if not want[i][4])
    assert decontaminate.find_hits(spark, hostile, b).count() == len(HOSTILE)
    assert decontaminate.find_hits(spark, none_of(hostile), b).count() == 0
    assert not decontaminate.find_hits(spark, d, none_of(b)).where("size(spans) > 0").count()


def test_index_of_many_items_with_one_window():
    items = [(f"i{k}", b"a b c d e f g h i j " + str(k).encode()) for k in range(300)] + [("short", b"A-b")]
    index = decontaminate.Index(items, 10)
    ((_, n, good, found),) = index.scan([b"x a b c d e f g h i j y"])
    assert n == 12 and good == {1: 10} and found == {i for i, _ in items}
    assert sum(x.nbytes for part in index.by_length.values() for x in part if isinstance(x, np.ndarray)) < 100 * 1024


def test_very_long_texts_and_clashing_columns(spark):
    long = "w0 " + " ".join(f"x{i}" for i in range(300_000)) + " one two three four five six seven eight nine ten " + "z" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, None), (None, "one two three four five six seven eight nine ten")] * 2, "doc_id long, text string").withColumns({"SPANS": F.lit(1), "_text": F.lit(2), "items": F.lit("x")})
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = decontaminate.find_hits(spark, docs, items).select("n_words", F.size("items").alias("n"), decontaminate.n_hit().alias("hit")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0)] * 2 + [(10, 1, 10)] * 2 + [(300_012, 1, 10)] * 2
    left = decontaminate.remove_hits(spark, docs, items)
    assert left.columns == docs.columns and [tuple(x) for x in left.collect()] == [(2, None, 1, 2, "x")] * 2
    spans = decontaminate.remove_hits(spark, docs, items, remove="spans").orderBy(F.length("text")).collect()
    assert [x["text"] for x in spans][:4] == [None, None, "", ""] and "one two" not in spans[-1]["text"] and spans[-1]["items"] == "x"


# 7: sharding.


def test_shards(spark, hostile):
    df = spark.range(1003).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "'en' as lang")
    got = sharding.op7_query(spark, df).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == r["doc_id"] % 50 + 8 and r["text_crc32"] == zlib.crc32(b"x" * (r["doc_id"] % 50))
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, sharding.op7_query(spark, df.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert sharding.hilbert_shards(spark, hostile).count() == len(HOSTILE)
    assert sharding.hilbert_shards(spark, none_of(hostile)).count() == 0


def test_hilbert_neighbours_touch():
    n = 4
    axes = np.array([(x, y, z) for x in range(1 << n) for y in range(1 << n) for z in range(1 << n)])
    index = sharding.hilbert_index(axes, n)
    assert sorted(index) == list(range(len(axes)))
    walk = axes[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# 8: HTML.

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="x"><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="ad">buy</div>
<div class="cookie-notice">accept</div><aside>side</aside><{tag}><h1>Head &amp; tail</h1><p>One <b>two</b>  three<p>Four&nbsp;five<br>six<script>var t="</p>";</script><ul><li>item <li>last</ul>
<form><p>name</p></form><section class="comments"><p>I object</p></section></{tag}><div id="sidebar">more</div><footer>&copy; foot</footer></body></html>"""
TEXT = "Head & tail\nOne two three\nFour five six\nitem\nlast"


def test_extraction(spark):
    rows = [(1, "http://h.com/1", PAGE.format(tag="article")), (2, "http://h.com/2", PAGE.format(tag='div class="post-12"').replace("</div class=\"post-12\">", "</div>")), (3, None, None), (4, "nonsense", ""), (5, "http://h.com/5", "plain <b>text"), (6, "http://h.com/6", "<p>a < b &lt;c&gt; <i>d</i></p><!-- <p>no</p> -->e"), (6, "http://h.com/6", "<div hidden><p>no</p></div><p>yes</p>"), (7, "http://i.com", "<div" * 500 + "<p x='" * 200 + "end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(spark, df).collect()]
    assert sorted(got)[:6] == [(1, TEXT), (2, TEXT), (3, ""), (4, ""), (5, "plain text"), (6, "a < b <c> d\ne")]
    assert (6, "yes") in got and len(got) == len(rows)
    q = html_text.op8_query(spark, df).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in q)
    assert html_text.extract_text(spark, none_of(df)).count() == 0


def test_extraction_by_join_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.com/{i}", PAGE.format(tag="article").replace("One", f"One {i}")) for i in range(40)], "page_id long, url string, html string")
    once = sorted(map(tuple, html_text.extract_text(spark, df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html_text.extract_text(spark, df).collect())) == once


class Plain(HTMLParser):
    """An independent extractor for well-formed pages: text of blocks inside the article."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.words = [], [], []

    def block(self):
        text = " ".join("".join(self.words).split())
        if text and "article" in self.open and not {"form", "aside", "script", "style", "nav"} & set(self.open):
            self.blocks.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        elif tag not in ("b", "a"):
            self.block()
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.block()
        self.open.pop()

    def handle_data(self, data):
        self.words.append(data)


def random_page(r):
    def words_():
        return "".join(r.choice(["word", "&amp;", "&#233;t&eacute;", "x < y", "a  \n b", "&nbsp;", "<b>bold</b>", "<br>", "<a href='/'>l</a>"]) + " " for _ in range(r.randrange(12)))

    def tree(depth):
        if not depth:
            return words_()
        script = "<div></div><script>var x = '<p>';</script><div></div>"
        return "".join((script if t == "script" else f"<{t}>{tree(depth - 1)}</{t}>") + words_() for t in r.choices(["p", "div", "section", "form", "aside", "h2", "blockquote", "script", "ul"], k=r.randrange(4)) if not (t == "p" and depth > 1))

    return f"<!DOCTYPE html><html><head><title>{words_()}</title></head><body><nav>{words_()}</nav><article><p>{'long enough ' * 30}</p>{tree(3)}</article><footer>{words_()}</footer></body></html>"


def test_extraction_equals_another_parser():
    r = random.Random(10)
    for _ in range(300):
        page = random_page(r).replace("x < y", "x &lt; y")
        other = Plain()
        other.feed(page)
        assert html_text.extract(page) == "\n".join(other.blocks), page


def test_doubtful_classes_go_by_the_host(spark):
    inside = '<section class="share-prices"><p>prices fell</p></section><div class="related-work">others wrote</div><div class="search-results">found nine</div><p class="notice">take care</p>'
    page = "<body><article><h1>t</h1><p>body {i} is a text of its own</p>{more}<div class='related-posts'>more here</div><div class='site-note share-bar'>share</div></article></body>"
    rows = [(i, f"http://one.com/{i}", page.format(i=i, more=inside if i == 0 else '<p class="notice">cookies!</p>')) for i in range(5)]
    rows += [(10 + i, "http://copies.com/x", page.format(i=1, more=inside)) for i in range(5)]
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = ["prices fell", "others wrote", "found nine", "take care"]
    assert got[0] == ["t", "body 0 is a text of its own", *kept] and got[3] == ["t", "body 3 is a text of its own"]
    assert all(got[10 + i] == ["t", "body 1 is a text of its own", *kept] for i in range(5))


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "end", "<div>x" * 100_000, "<p x='" * 150_000, '<a b="' * 150_000 + ">", "<script>" + "</script " * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<x>" * 100_000 + "</y>" * 100_000, "<li><x>" * 60_000, f"<div {'a' * 1_000_000}=1>t</div>", "&#" + "9" * 500_000 + ";", "<b hidden>" * 60_000 + "</b>" * 60_000, "<p>" + "x" * 1_000_000])
def test_hostile_pages_take_little_time(page):
    began = time.perf_counter()
    text = html_text.extract(page)
    assert time.perf_counter() - began < 8 and len(text) <= len(page)


def test_hosts(spark):
    urls = {"http://Bad.com./x": "bad.com", "http://[::1]:80/": "[::1]", "//bad.com/x": "bad.com", "https://a@b:c@bad.com:8/": "bad.com", "bad.com/x": "", "mailto:x": "", "http:///x": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_text.host_of().alias("h"))
    assert {r["url"]: r["h"] for r in df.collect()} == urls


# 9: licences.


def test_licenses(spark, hostile):
    rows = [(1, "Under the MIT License; and mit-license. GNU  General Public\nLicense, version 3"), (2, "CC BY-NC 4.0"), (3, None), (4, "mit and license"), (5, "Kmit license é"), (6, "mit license"), (7, "ſmit license")]
    got = {r["doc_id"]: r for r in licenses.op9_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"]) == (3, 2, 7, "gpl,mit", "gpl,gpl-3.0,mit")
    assert (got[2]["base_labels"], got[2]["labels"], got[2]["n_words"]) == ("cc-by", "cc-by,cc-by-nc", 5)
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == "" and got[4]["n_base"] == 0
    assert got[5]["n_base"] == got[7]["n_base"] == 0 and got[6]["n_base"] == 1
    assert licenses.scan_licenses(hostile).count() == len(HOSTILE)
    assert licenses.op9_query(none_of(hostile)).count() == 0


def test_notices_by_relative_position(spark):
    text = {name: w for (_, name), (w, _) in licenses.NOTICES.items()}
    r = random.Random(7)
    rows, want = [(0, " ".join(text.values())), (1, ""), (2, None)], {0: {label for label, _ in licenses.NOTICES} | {"gpl", "apache", "mpl"}}
    for label, name in licenses.NOTICES:
        w = text[name].split()
        for _ in range(3):  # one word changed anywhere
            at = r.randrange(len(w))
            changed = ["intro", "words;"] * r.randrange(9) + [*w[:at], "changed", *w[at + 1 :]] + ["tail"] * r.randrange(9)
            want[len(rows)] = {label}
            rows.append((len(rows), "\n * ".join(x.upper() if r.random() < 0.3 else x for x in changed)))
        shuffled = w[:]
        r.shuffle(shuffled)
        rows.append((len(rows), " ".join(shuffled)))
        cut = w[6:]  # the beginning is lost
        want[len(rows)] = {label} if label != "mpl" else set()
        rows.append((len(rows), " ".join(cut)))
    got = {x["doc_id"]: x for x in licenses.op9_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, labels in want.items():
        assert labels <= set(got[i]["labels"].split(",")), (rows[i], got[i])
    assert got[1]["labels"] == got[2]["labels"] == "" and all(0 <= x["score"] <= 1 for x in got.values())
    plain = [x for x in got.values() if x["doc_id"] not in want]
    assert not any(label in x["labels"].split(",") for x in plain for label in ("zlib", "bsl", "wtfpl"))


def test_base_places_equal_brute_force(spark):
    r = random.Random(11)
    vocabulary = "gnu general public license apache cc by mit licence x the".split()
    rows = [(i, "".join(r.choice(vocabulary) + r.choice([" ", "-", ", ", "\n"]) for _ in range(r.randrange(80)))) for i in range(200)]
    rows += [(300, "mit license " * 30_000), (301, "public " * 100_000 + "MIT\tLicense")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").withColumns({"w": F.lit(1), "AT": F.lit(2), "row": F.lit(3), "Found": F.lit("x")})
    assert licenses.scan_licenses(docs).columns == ["doc_id", "text", "w", "AT", "row", "n_words", "found"]
    for x in licenses.op9_query(docs).collect():
        w = [t for t in re.split("[^a-z0-9]+", dict(rows)[x["doc_id"]].lower()) if t]
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in places}))


# 10: language.


@pytest.mark.parametrize("kind", [language.Dense, language.Hashed])
def test_suffix_automaton_knows_all_substrings(kind):
    r = random.Random(3)
    s = np.array([r.randrange(3) for _ in range(60)])
    steps = kind(language.suffix_automaton(s), 5)
    known = {tuple(s[i:j].tolist()) for i in range(60) for j in range(i, 61)}
    for _ in range(400):
        q, state, whole = [r.randrange(3) for _ in range(r.randrange(1, 9))], np.array([steps.between], np.int32), True
        for i, c in enumerate(q):
            state, begins = steps(state, np.array([c], np.int32))
            whole &= i == 0 or not begins[0]
        assert whole == (tuple(q) in known)


@pytest.mark.parametrize("segment,dense", [(256, 1 << 23), (16, 1 << 23), (16, 0), (3, 0)])
def test_phrases_equal_a_greedy_parse(monkeypatch, segment, dense):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "DENSE", dense)
    r = random.Random(3)
    learned = {k: "".join(r.choice(v) for _ in range(900)) for k, v in {"x": "abc ", "y": "cde ", "z": ["ab ab c", "de", "𠀋", "我"], "w": "a"}.items()}
    model = language.Model({k: language.letters(v.encode()) for k, v in learned.items()})
    parts = ["a", "b", "c", "d", "e", " ", "𠀋", "\U00030000", "我", "你", learned["z"][100:300], learned["x"][5:90], "a" * 50]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(40)] + ["", "a" * 900, learned["x"], learned["y"] * 2]
    low = [language.letters(t.encode()) for t in texts]
    got = model.phrases([model.numbers(x) for x in low])
    for i, x in enumerate(low):
        text = "".join(chr(c) if c else " " for c in x)
        for k, lang in enumerate(model.langs):
            have = "".join(chr(c) if c else " " for c in language.letters(learned[lang].encode()))
            n, at = 0, 0
            while at < len(text):
                to = at + 1
                while to < len(text) and text[at : to + 1] in have:
                    to += 1
                n, at = n + 1, to
            assert got[i][k] == n, (text, lang)


def test_languages_of_large_alphabets(spark):
    r = random.Random(6)
    scripts = {"zh": range(0x4E00, 0x5E00), "ja": range(0x5A00, 0x6A00), "ko": range(0xAC00, 0xB800), "far": range(0x20000, 0x20800)}
    docs = [(i, "".join(chr(r.choice(scripts[k])) for _ in range(300)), k) for i, k in enumerate(list(scripts) * 40)]
    docs += [(900, "x" * 200_000 + "我", None), (901, docs[0][1], None)]
    got = {x["doc_id"]: x["lang_pred"] for x in language.op10_query(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i] == k for i, _, k in docs[:160]) >= 150 and got[901] == "zh" and got[900] in scripts


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, f"text number {i} " * 20, "en") for i in range(300)] + [(5000, "same same", "en")] * 400 + [(6000 + i, "lang " * 20_000, "de") for i in range(3)] + [(None, "no id", "fr")]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"en", "de"} and len(got["de"]) == language.SYMBOLS + 1 and language.SYMBOLS * 0.5 < len(got["en"]) <= language.SYMBOLS + 100
    assert got["en"].count("same same") <= 1


def test_language(spark, hostile):
    r = random.Random(5)
    syllables = {"en": ["the ", "ing ", "ation", "wh"], "de": ["sch", "ung ", "der ", "ü"], "fr": ["é", "eaux ", "que ", "ment "]}
    rows = [(i, "".join(r.choice(syllables[k]) for _ in range(80)), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "schungderü", None)]
    got = {x["doc_id"]: x for x in language.op10_query(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:180])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.identify_language(spark, hostile).count() == len(HOSTILE)
    assert language.identify_language(spark, none_of(hostile)).count() == 0
    unlabelled = hostile.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in language.identify_language(spark, unlabelled).collect()} == {"und"}
