"""Mixing, ranked search and centroid clustering against plain versions and SQL, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import catalog, centroids, lexical, mixing

SF = "/root/testdata/sf0.001"


def in_duckdb(name, table, *tables):
    con = duckdb.connect()
    for t in (table, *tables):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(catalog.SQL[name])
    return found.columns, found.fetchall()


@pytest.mark.parametrize("name, tables", [("op12_max_sketch_search", ("documents", "benchmark")), ("op13_simplex_clustering", ("embeddings",))])
def test_sql(spark, name, tables):
    columns, want = in_duckdb(name, *tables)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and want
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


# mixing


def all_sums(lengths, counts):
    sums = {0}
    for length, n in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 300))
def test_nearest_sum_is_the_best_of_all_subsets(rows, goal):
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    take = mixing.nearest_sum(lengths, counts, goal)
    assert ((0 <= take) & (take <= counts)).all()
    assert abs(int((take * lengths).sum()) - goal) == min(abs(s - goal) for s in all_sums(lengths.tolist(), counts.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 400)), min_size=1, max_size=80, unique_by=lambda x: x[0]), st.floats(0, 1), st.sampled_from([50, 1000, mixing.BUDGET]))
def test_shares_stay_within_counts_and_near_the_goal(rows, part, budget):
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    goal = int(part * (lengths * counts).sum())
    take = mixing.shares(lengths, counts, goal, budget)
    assert ((0 <= take) & (take <= counts)).all()
    assert abs(int((take * lengths).sum()) - goal) <= int(lengths.max()) / 2 + 1


def test_sums_of_long_documents():
    take = mixing.shares(np.array([900_000, 700_000]), np.array([1, 1]), 860_000, 1000)
    assert take.tolist() == [0, 1]  # the longest that fits, then nothing is nearer
    assert mixing.shares(np.array([900_000]), np.array([1]), 860_000, 1000).tolist() == [1]
    assert mixing.shares(np.array([900_000]), np.array([5]), 400_000, 1000).tolist() == [0]


def water(totals):
    """source: target, by raising one level until all words are dealt."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    everything, lo, hi = sum(totals.values()), 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 3 * totals[s]) for s in order) < everything else (lo, mid)
    return {s: min(weight[s] * hi, 3 * totals[s]) for s in order}


DOCS = "doc_id long, text string, source string, size long, total long, n long, h long, take long, range long, part int, weight int, target string, _source string"


def mixed(spark, rows):
    df = spark.createDataFrame([(d, t, s, 1, 1, 1, 1, 1, 1, 1, 1, "x", "y") for d, t, s in rows], DOCS).repartition(3)
    return mixing.mix(df).collect()


def checked(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = water(totals)
    for s in totals:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == totals[s] and r.target == pytest.approx(want[s]) for r in own)
        least = min((r.copies for r in own if r["size"]), default=0)
        assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] and r.copies - least in (0, 1) for r in own if r["size"])
        assert abs(sum(r.taken for r in own) - want[s]) <= max(1, max(r["size"] for r in own) / 2)


def test_mixing_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    got = mixing.mix(docs).collect()
    checked(rows, got)
    # each source's choice is as near to its target as any subset of its documents
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        rest = round(own[0].target) - own[0].source_size * int(own[0].target // own[0].source_size)
        chosen = sum(r.taken for r in own) - own[0].source_size * int(own[0].target // own[0].source_size)
        assert abs(chosen - rest) == min(abs(x - rest) for x in all_sums([r["size"] for r in own], [1] * len(own)))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), "b") for i in range(300)] + [(1000 + i, "same number of words", "a") for i in range(5000)]
    rows += [(None, None, None), (None, "x y", None), (5, "", "é"), (6, " \t\n\x0b\x0c\r ", "é"), (7, "a b c d\x1f", "é"), (8, "long " * 200_000, "z"), (8, "long " * 200_000, "z"), (9, "one", "😀")]
    got = mixed(spark, rows)
    checked(rows, got)
    assert mixed(spark, [(1, "", "a"), (2, None, None)])[0].taken == 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_choice_is_seeded_and_by_hash(spark):
    rows = [(i, "four words in all", "a") for i in range(3000)] + [(9000 + i, "x", "b") for i in range(10)]
    one = {r.doc_id for r in mixed(spark, rows) if r.taken > 4 and r.source == "a"}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    two = {r.doc_id for r in mixing.mix(df, seed=12).collect() if r.taken > 4 and r.source == "a"}
    assert one == {r.doc_id for r in mixing.mix(df).collect() if r.taken > 4 and r.source == "a"}
    assert len(one) == len(two) or not one or one != two


# search


def ranked(docs, items, top=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, total, df = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out, asked = [], {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for i, own in asked.items():
        found = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in own if b[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=lambda x: x[:2])


def search_rows():
    rng = random.Random(8)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for i in range(700)]
    copy = "t1 Wörter und t2 ABC abc"
    docs += [(1000 + i, copy) for i in range(120)] + [(3, docs[3][1]), (None, copy), (None, "t5"), (2000, None), (2001, ""), (2002, "!?. \x7f"), (2003, "t1 " * 90_000 + "t77"), (2004, "É é ÀB àb"), (2005, "x" * 2000 + " " + "y" * 200_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    items += [(100, copy), (101, None), (102, ""), (103, "nowhere at all"), (None, "t1"), (104, "É"), (105, "T1!t1"), (1, "t9 t10 ABC"), (106, "x" * 2000)]
    return docs, items


@pytest.mark.parametrize("bytes_of_a_pass", [256 << 10, 2000])
def test_search(spark, monkeypatch, bytes_of_a_pass):
    monkeypatch.setattr(lexical, "BATCH_BYTES", bytes_of_a_pass)
    docs, items = search_rows()
    df = spark.createDataFrame([(d, t, 1, 1, 1, 1) for d, t in docs], "doc_id long, text string, item long, rank int, score long, salt int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = lexical.search(df, asked).collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == ranked(docs, items)
    assert sorted(map(tuple, lexical.search(df, asked, top=3).collect()), key=lambda x: x[:2]) == ranked(docs, items, 3)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(none.union(items), items.limit(0)).count() == 0
    assert lexical.search(none.union(items.selectExpr("item_id", "null")), items).count() == 0


def test_terms_of_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 64)
    rng = random.Random(4)
    texts = ["", None, "a" * 500 + " b", *(" ".join(rng.choice(["a", "B", "b", "é" * 40, "cc"]) for _ in range(rng.randint(0, 200))) for _ in range(20))]
    owner, term, times = lexical.counted(texts)
    assert sorted(zip(owner.tolist(), term.tolist(), strict=True)) == list(zip(owner.tolist(), term.tolist(), strict=True))
    want = [Counter(re.findall(r"[^ ]+", (t or "").lower())) for t in texts]
    for i, w in enumerate(want):
        assert sorted(times[owner == i].tolist()) == sorted(w.values())


def test_sketches_bound_scores_and_save_scoring(spark):
    """No document is missed by its bound, and most are never scored."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    asked = lexical.batch([i for i, _ in items], [t for _, t in items])
    owner, term, times = lexical.counted(docs)
    at = lexical._places(term, asked.terms)
    known = lexical.Statistics(len(set(owner.tolist())), int(times.sum()), np.bincount(at[at >= 0], minlength=len(asked.terms)))
    impact = lexical.impacts(owner, times, known, len(docs))
    upper = lexical.sketches(owner, term, impact, len(docs)) @ lexical.lookups(asked, known.weights())
    key = owner[at >= 0] * len(asked.terms) + at[at >= 0]
    needed = 0
    for i in range(len(items)):
        places = asked.places[asked.first[i] : asked.first[i] + asked.count[i]]
        score = lexical._exact(key, impact[at >= 0], np.arange(len(docs)), places, known.weights()[places], len(asked.terms))
        assert (upper[:, i] >= score).all()
        needed += int((upper[:, i] >= np.sort(score)[-50]).sum())
    assert needed < 0.25 * len(items) * len(docs)


# clustering


def clustered(rows, clusters=8, rounds=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in good:
            own[nearest(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, at, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in good]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    total = sum(inertia.values())
    return [(i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found]


def vectors(case):
    rng = np.random.default_rng(5)
    near = rng.normal(0, 0.1, (9, 64))
    if case == "groups":
        rows = [(i, (near[i % 9] + rng.normal(0, 0.02, 64)).tolist()) for i in range(400)]
        odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [-1e4] * 64]
        return rows + [(500 + i, v) for i, v in enumerate(odd)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])] + [(600 + i, rows[7][1]) for i in range(80)]
    if case == "line":
        return [(i, [i / 64] * 64) for i in range(60)]
    if case == "same":
        return [(i, [0.25] * 64) for i in range(30)]
    if case == "few":
        return [(i, near[i].tolist()) for i in range(3)]
    return [(1, [0.1] * 5), (2, None)]


@pytest.mark.parametrize("case", ["groups", "line", "same", "few", "none"])
def test_clusters(spark, case):
    rows = vectors(case)
    df = spark.createDataFrame([(i, v, 1, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, apex double, v string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=key) == sorted(clustered(rows), key=key)
    assert centroids.cluster(df.limit(0)).count() == 0


def test_components_that_cannot_be_squared_are_told(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        centroids.cluster(df)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.sampled_from([1, 30, 100_000]))
def test_bounds_hold_the_distance(seed, pivots, spread):
    rng = np.random.default_rng(seed)
    made = rng.integers(-spread, spread + 1, (60, 64))
    made[1::7] = made[0]
    base = centroids.simplex(made[:pivots])
    apex = base.apex(made)
    low, high = centroids.bounds(apex, apex[30:40])
    true = np.sqrt(centroids.squared(made, made[30:40]))
    slack = centroids.SLACK * (1 + np.abs(apex).sum(axis=1, keepdims=True) + np.abs(apex[30:40]).sum(axis=1))
    assert (low - slack <= true).all() and (true <= high + slack).all()
    best, least, _ = centroids.assign(made, apex, made[30:40], base)
    assert (best == true.argmin(axis=1)).all() and (least == centroids.squared(made, made[30:40]).min(axis=1)).all()


def test_bounds_save_distances(spark):
    rows = vectors("groups")
    made = np.floor(1024 * np.array([v for _, v in rows[:400]])).astype(np.int64)
    base = centroids.simplex(made[:40])
    _, _, taken = centroids.assign(made, base.apex(made), made[:8], base)
    assert taken < 0.5 * 8 * len(made)
    assert all(a != b for a, b in itertools.pairwise(base.pivots.tolist()))
