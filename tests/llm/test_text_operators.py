"""Decontamination, repeats, personal data, shards and near copies against plain versions, with odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import catalog, decontamination, graph, jaccard_join, pii, repeats, sharding, stages

from . import plain

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, w string, h long, n long, node long, base string, size long, part int, rid long, len int, a long, z long"


def docs(spark, rows):
    """A table with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, "w", 1, 1, 1, "b", 1, 1, 1, 1, 1, 1) for d, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("windows", [200_000, 0])
def test_decontamination(spark, monkeypatch, corpus, windows):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", windows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in catalog.op1_benchmark_decontamination(spark, SF).collect()}
    for d, t in corpus:
        n, hit, found, bad = plain.contamination(t, items)
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (n, hit, len(found), bad)


@pytest.mark.parametrize("windows", [200_000, 0])
def test_decontamination_of_odd_rows(spark, monkeypatch, windows):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", windows)
    long_item = " ".join(f"w{i}" for i in range(15))
    items = [(1, long_item), (10, long_item), (2, "Short one"), (3, None), (4, ""), (5, "!!"), (None, "null id item words"), (2, "Short one")]
    texts = [None, "", "!!", "a short ONE here", long_item.upper(), "x " + long_item + " y", long_item + " " + long_item, "w1 w2", "null id item words", "short one short one short", "é" * 5000 + " short one", long_item.replace(" ", "\n--")]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    found = decontamination.verdicts(decontamination.contamination(docs(spark, rows), bench)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found)
    known = [(i, t) for i, t in items if i is not None]
    want = []
    for d, t in rows:
        n, hit, ids, bad = plain.contamination(t, known)
        want.append((d is None, d or 0, n, hit, tuple(ids), bad))
    assert got == sorted(want)


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs(spark, [(1, "x")]), bench).first()["items"] == []
    assert pii.detect(none).count() == sharding.shard_by_bytes(none).count() == 0
    assert repeats.remove_repeats(none).count() == jaccard_join.similar_classes(none).count() == 0


def repeated_rows():
    rng = random.Random(3)
    vocabulary = [f"wörd{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(40)
    rows = [(i, base) for i in range(4)] + [(10 + i, f"{text(30)} {passage} {text(20)}") for i in range(25)]
    for i in range(25):
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = f"X{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "a" * 1000), (201, "ab" * 400), (202, None), (203, ""), (204, "a" * 199), (205, "b" * 200), (206, "c" * 201), (None, base), (0, base), (207, base[:230])]
    return rows


@pytest.mark.parametrize("local, broadcast", [(1024, 1_000_000), (3, 0)])
def test_repeats(spark, monkeypatch, local, broadcast):
    monkeypatch.setattr(repeats, "LOCAL", local)
    monkeypatch.setattr(repeats, "BROADCAST", broadcast)
    rows = repeated_rows()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, rows)).collect())
    want = sorted((str(d), *x) for (d, _), x in zip(rows, plain.repeats([t for _, t in rows]), strict=True))
    assert got == want


def test_repeats_over_the_table(spark, corpus):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.op2_suffix_dedup(spark, SF).collect()}
    assert [got[d] for d, _ in corpus] == plain.repeats([t for _, t in corpus])


ODD = [
    None, "", "a@b.c_d@e.f", "x" * 5000, "a@b.", "..@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111 1111-1111-5", "1 " * 3000,
    "4111111111111111", "411111111111111 1", "+1 (555) 010-9999 and +1", "+49 30 1234567)", "++1 23 45 67 89 0", "é😀 mail: Ä.b@ö.de b@x-y.org.", "call (555) 010-9999", "token = \"" + "a1" * 20 + "\"", "9" * 30,
    "@handle me@x.com@y.com", "1.1.1.1@2.2", "12  34", "5- 5",
]


def test_personal_data(spark, corpus):
    rows = list(enumerate(ODD)) + [(1000 + d, t) for d, t in corpus] + [(None, "a@b.cd"), (3, ODD[3])]
    seen = 0
    by = {(None if d is None else d): t for d, t in rows}
    for r in pii.detect(docs(spark, rows)).collect():
        base = [tuple(x) for x in r.base]
        assert base == plain.personal(by[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        spans = [tuple(x) for x in r.spans]
        assert set(base) <= set(spans) and spans == sorted(spans)
        assert all(not (x[0] < y[2] and y[0] < x[2]) for x in spans if x[1] == 4 for y in base)
        seen += 1
    assert seen == len(rows)


def account(country, rest):
    """An account number whose check digits are right."""
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


def test_added_spans_are_the_planted_ones(spark):
    rng = random.Random(4)
    hex_ = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = {
        "token": lambda: ('token = "', hex_(40), '"'),
        "key": lambda: ("api key: ", f"sk_live_{hex_(24)}", "."),
        "access": lambda: ("secret ", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQ234567") for _ in range(16)), " in"),
        "account": lambda: ("iban ", account("DE", digits(18)), " of"),
        "number": lambda: ("ssn ", f"{digits(3)}-{digits(2)}-{digits(4)}", ","),
        "phone": lambda: ("call ", f"(555) {digits(3)}-{digits(4)}", " now"),
    }
    clean = ["internationalisierungsstrategien", "at 12:34:56 on 2024-01-02", "pages 12-34", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "version 3.11.4", "x=1", "in 1999 and 2000", "Chapter 7: the end"]
    rows, planted = [], {}
    for i in range(600):
        before = " ".join(word() for _ in range(12)) + " "
        if i % 3 == 0:
            a, m, z = kinds[list(kinds)[i // 3 % len(kinds)]]()
            planted[i] = (len(before) + len(a), len(before) + len(a) + len(m))
            rows.append((i, f"{before}{a}{m}{z} {word()}"))
        else:
            rows.append((i, f"{before}{rng.choice(clean)} {word()}"))
    got = {r.doc_id: [(x.start, x.end) for x in r.spans if x.rank == 4] for r in pii.detect(docs(spark, rows)).collect()}
    caught = sum(any(a < z and x < b for x, z in got[i]) for i, (a, b) in planted.items()) / len(planted)
    alone = sum(not got[i] for i, _ in rows if i not in planted) / (len(rows) - len(planted))
    exact = sum((a, b) in got[i] for i, (a, b) in planted.items()) / len(planted)
    assert caught >= 0.8 and alone >= 0.98 and exact >= 0.75, (caught, alone, exact)


def test_account_numbers_are_checked(spark):
    rows = [("GB82 WEST 1234 5698 7654 32", True), ("GB83 WEST 1234 5698 7654 32", False), ("DE89370400440532013000", True), (account("FR", "20041010050500013M02606"), True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(pii._mod97(F.col("t")) == F.col("want")).count() == len(rows)


def test_redaction(spark):
    df = pii.detect(docs(spark, [(1, "é a@b.cd, 1.2.3.4 end")])).join(docs(spark, [(1, "é a@b.cd, 1.2.3.4 end")]).select("doc_id", "text"), "doc_id")
    assert df.select(pii.redact(F.col("text"), F.col("spans"))).first()[0] == "é [EMAIL], [IP] end"


def test_reliabilities_find_the_good_labeler():
    rng = random.Random(1)
    votes = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        p = tuple(int(rng.random() < (a if y else b)) for a, b in [(0.95, 0.05), (0.7, 0.2), (0.6, 0.4)])
        votes[p] = votes.get(p, 0) + 1
    post, rates = pii.reliabilities(votes)
    assert post[(1, 1, 1)] > 0.9 and post[(0, 0, 0)] < 0.1
    assert rates[0][0] - rates[0][1] > rates[1][0] - rates[1][1] > rates[2][0] - rates[2][1]
    assert pii.reliabilities({}) == ({}, []) and pii.fit_classifier([]) == [0.0] * (1 + len(pii.FEATURES))


def test_shards(spark, corpus):
    rows = corpus + [(None, None), (5, ""), (5, ""), (7, "x" * 3000)]
    got = sharding.shard_by_bytes(docs(spark, rows), 7).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(7):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= most
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order == sorted(order)


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows += [(i, " ".join(common + [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))])) for i in range(90, 200)]
    return rows + [(300, None), (301, ""), (302, "!!"), (303, "!!"), (None, "a b"), (304, "one two"), (305, "One, two"), (3, rows[3][1])]


@pytest.mark.parametrize("bucket, block", [(256, 512), (16, 32)])
def test_near_copies(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows()
    found = jaccard_join.similar_classes(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in found}
    want = plain.classes(rows)
    assert {d: got[d] for d in want} == want
    assert got[300] == got[301] == (300, 0) and got[302] == got[303] == (302, 0) and got[None] == (None, 0)


def test_runs_reach_the_recall():
    assert jaccard_join.runs(1e-4) == 15 and jaccard_join.runs(1e-2) < jaccard_join.runs(1e-4)


def test_split_nodes_and_sketches_are_in_the_bound():
    every, deep = jaccard_join.all_runs(1e-4)
    chance = jaccard_join.apart(jaccard_join.LEVELS) ** every + jaccard_join.apart(jaccard_join.DEEPEST) ** deep + jaccard_join.unlike()
    assert chance <= 1e-4


def test_near_copies_of_one_template(spark, monkeypatch):
    rng = random.Random(9)
    common, rows = [f"t{i}" for i in range(90)], []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(50)]
        other = own[:-10] + [f"p{i}x{j}" for j in range(rng.choice([8, 9, 10, 40]))]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + other))]
    further = []
    made = jaccard_join._further
    monkeypatch.setattr(jaccard_join, "_further", lambda *a: further.append(1) or made(*a))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similar_classes(docs(spark, rows)).collect()}
    assert further and got == plain.classes(rows)


def test_recall_over_a_table(spark):
    """Classes and links of a whole table against all pairs of sets."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in catalog.op10_jaccard_join(spark, sf).collect()}
    want = plain.classes(rows)
    links = sum(n for _, n in want.values())
    assert links > 0 and sum(min(got[d][1], n) for d, (_, n) in want.items()) >= 0.999 * links
    assert sum(got[d] == x for d, x in want.items()) >= 0.999 * len(want)


STAGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, _spans string, n long, key string"


def stage_rows(spark):
    """Odd rows with columns whose names the stages or their operators use."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, "12 34 !!"), (4, "the cat and the dog went over there to see it"), (4, "the cat and the dog went over there to see it"), (5, "the cat and the dog went over there to see it"),
        (6, "mail a@b.cd now"), (6, "another text with this id, which is not alike"), (None, "the end of the text"), (None, "the end of the text"), (7, long_text), (8, "call +49 30 1234567 é😀"), (9, long_text + " x"),
    ]
    return spark.createDataFrame([(d, t, None if d == 8 else "en", None, len(t or ""), 1, "s", 1, "k") for d, t in texts], STAGE_DOCS).repartition(3)


@pytest.mark.parametrize("stage", ["identify_language", "drop_near_copies", "decontaminate", "redact_personal_data", "pack_sequences"])
def test_stages_on_odd_rows(spark, stage):
    df, work = stage_rows(spark), getattr(stages, stage)
    out = work(spark, df, SF)
    rows = out.collect()
    assert work(spark, df.limit(0), SF).count() == 0
    if stage == "pack_sequences":
        assert sum(r.piece == 0 for r in rows) == df.count() and sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
        return
    assert out.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    given = sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    if stage == "identify_language":
        assert ids == [x for x in given if x[1] not in (1, 2, 3)]
    elif stage == "drop_near_copies":  # 2 copies 1, 5 and the second 4 copy 4, 9 copies 7; both texts of 6 stay
        assert ids == [(False, i) for i in (1, 3, 4, 6, 6, 7, 8)] + [(True, 0)] * 2
    elif stage == "decontaminate":
        assert ids == given
    else:
        assert ids == given
        by = {(r.doc_id, r.text) for r in rows}
        assert {(1, None), (2, ""), (6, "mail [EMAIL] now"), (8, "call [PHONE] é😀")} <= by
        assert all(r.n_chars == len(r.text or "") for r in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (101, 100)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_nodes_pass_in_any_batches(spark, batch):
    """Nodes of one set, of a few and of more than a bucket, cut anywhere by batches."""
    rng = random.Random(6)
    sizes = [1, 2, 3, 256, 257, 700, 1, 5, 1, 1, 300, 256]
    rows = [(i, node) for node, n in enumerate(sizes) for i in rng.sample(range(2000), n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        few, many = (df.collect() for df in jaccard_join._shared(spark.createDataFrame(rows, "rep long, node long").repartition(5)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    of = {node: sorted(i for i, k in rows if k == node) for node in range(len(sizes))}
    assert sorted(map(tuple, few)) == sorted((i, node) for node, n in enumerate(sizes) if 1 < n <= jaccard_join.BUCKET for i in of[node])
    assert sorted(map(tuple, many)) == sorted((i, node, of[node][0]) for node, n in enumerate(sizes) if n > jaccard_join.BUCKET for i in of[node])
