import random

import pytest

from treeparity.llm import near_dedup


def brute(rows):
    """Components by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def edit(r, words, share):
    return [f"n{r.randrange(10**6)}" if r.random() < share else w for w in words]


@pytest.mark.parametrize("leaf", [16, 3])
def test_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (7, "two one")]
    passage = [f"p{i}" for i in range(25)]
    for g in range(12):
        base = [f"g{g}w{r.randrange(60)}" for _ in range(r.randrange(20, 120))]
        for _ in range(r.choice([1, 2, 5, 30])):
            rows.append((len(rows) + 100, " ".join(edit(r, base, r.choice([0, 0.01, 0.03, 0.06])))))
    for i in range(40):  # documents that share a passage and are no near copies
        rows.append((len(rows) + 100, " ".join(passage + [f"u{i}x{k}" for k in range(r.randrange(20, 40))])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(spark, df).collect())
    assert got == brute(rows)


def test_repeated_rows_nulls_and_extra_columns(spark):
    rows = [(7, "a b c d e f g", 1), (7, "a b c d e f g", 2), (9, "A b c d e f g", 3), (None, "z", 4), (11, "q r", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = [tuple(x) for x in near_dedup.near_duplicates(spark, df).collect()]
    assert sorted(got, key=repr) == sorted([(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 1, None, True), (11, 1, 11, True)], key=repr)


def test_a_null_id_among_copies(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(i, " ".join(base)) for i in (8, None, 5, None, 6)] + [(3, near)]
    rows += [(None, " ".join(f"v{i}" for i in range(30))), (None, " ".join(f"v{i}" for i in range(31)))]
    got = [tuple(x) for x in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(i, 56, 3, i == 3) for i in (8, None, 5, None, 6, 3)] + [(None, 26, None, True), (None, 27, None, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trees_miss_few_pairs_that_go_on_to_the_last_coordinate(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 0)
    monkeypatch.setattr(near_dedup, "SETTLED", 2)
    r, n = random.Random(8), 1500
    rows = []
    for i in range(n):  # pairs at 0.75, alone with each other
        x = [[r.randbytes(4) for _ in range(near_dedup.WIDE)], [r.randbytes(1) for _ in range(near_dedup.NARROW)]]
        y = [[c if r.random() < 0.75 else r.randbytes(len(c)) for c in part] for part in x]
        rows += [(2 * i + side, bytearray(b"".join(z[0] + z[1]))) for side, z in enumerate((x, y))]
    nodes = spark.createDataFrame(rows, "node long, sketch binary")
    met = near_dedup.chosen_paths(nodes, near_dedup.Scratch(spark, "recall"))
    pairs = met.selectExpr("key", "node div 2 as pair").groupBy("key", "pair").count().where("count > 1").select("pair").distinct().count()
    assert pairs >= n - 8


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(spark, df).count() == 0


def test_sets_in_slices_link_as_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SET_BYTES", 900)
    r = random.Random(9)
    rows = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(10 * g + k, " ".join(edit(r, base, 0.03 * (k > 0)))) for k in range(6)]
    import pyarrow as pa
    import zstandard

    packed = [zstandard.compress(t.encode()) for _, t in rows]
    table = pa.table({"node": [i for i, _ in rows], "c": [i for i, _ in rows], "packed": packed})
    monkeypatch.setattr(near_dedup, "SET_BYTES", 900)
    some = near_dedup._links_in_block(table).to_pydict()
    monkeypatch.setattr(near_dedup, "SET_BYTES", 64 << 20)
    assert some == near_dedup._links_in_block(table).to_pydict() and some["a"]


def test_very_long_texts(spark):
    long = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-9])), (3, " ".join(reversed(long))), (4, "w" * 3_000_000)]
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 399_996, 1, True), (2, 399_987, 1, False), (3, 399_996, 3, True), (4, 1, 4, True)]
