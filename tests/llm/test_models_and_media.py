"""Media, packing, language, archives, scoring and the pipeline: round trips, plain versions and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import catalog, flac, language, packing, scoring, warc
from seriesloom.llm.common import id_crc

from . import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


PAYLOADS = [
    bytes(64), b"a" * 64, bytes(range(256)), b"a" * 5000 + b"\xff" + b"a" * 63, bytes([0, 255] * 32), np.random.default_rng(0).integers(0, 256, 64 * 40).astype(np.uint8).tobytes(),
    (bytes(1000) + b"\xff") * 64, bytes((np.cumsum(np.arange(6400)) % 251).astype(np.uint8)), bytes((128 + 100 * np.sin(np.arange(4096) / 20)).astype(np.uint8)), b"x" * 1024 * 300,
]


def test_flac_round_trip():
    files = flac.encode(PAYLOADS)
    assert [x.tobytes() for x in flac.decode(files)] == PAYLOADS
    assert len(files[8]) < 0.8 * len(PAYLOADS[8]) and len(files[-1]) < 0.05 * len(PAYLOADS[-1])
    assert flac.encode([PAYLOADS[2]])[0] == files[2]  # equal payloads, equal files


def crc(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & (1 << bits) - 1
    return c


def test_checksums():
    data = np.frombuffer(b"abc" + bytes(range(200)), dtype=np.uint8)
    for bits, poly in ((8, 0x07), (16, 0x8005)):
        got = flac.crcs(data, np.array([0, 3]), np.array([3, 200]), bits)
        assert got.tolist() == [crc(b"abc", bits, poly), crc(bytes(range(200)), bits, poly)]


@pytest.mark.parametrize("at", [0, 30, -1, -60, 70])
def test_damaged_flac(at):
    file = bytearray(flac.encode([b"some text " * 64])[0])
    file[at] ^= 0x55
    with pytest.raises((ValueError, IndexError)):
        flac.decode([bytes(file)])


def test_media_column(spark, corpus):
    rows = [(1, None, 3), (2, "", 3), (3, "x" * 64, 3), (4, "é" * 100, 3), (4, "é" * 100, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = flac.encode_column(df)
    got = {r.doc_id: r for r in flac.media_digest(media).collect()}
    for d, t, _ in rows:
        p = flac.payload(t)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(media, 64).where("doc_id = 3 or doc_id = 1").orderBy("doc_id", "sample").collect()
    assert [(r.doc_id, r.sample, bytes(r.pcm)) for r in blocks] == [(1, 0, bytes(64)), (3, 0, b"x" * 64)]
    assert flac.media_digest(flac.encode_column(df.limit(0))).count() == 0
    digests = {r.doc_id: r.payload_sha256 for r in catalog.op4_flac_media(spark, SF).collect()}
    assert digests == {d: hashlib.sha256(flac.payload(t)).hexdigest() for d, t in corpus.items()}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_ids_are_the_librarys(corpus):
    odd = ["", " ", "  two  spaces ", "tab\t and\n new\n\n line", "it's we'll I'D", "a<|endoftext|>b <|endoftext|>", "é😀 ñandú 12 345", " lead", "trail ", "x y  z", "　a b", "a \n b", "#$% &*( 7a a7"]
    bpe, want = packing.tokenizer(), tokenizer()
    for t in odd + list(corpus.values())[:120]:
        assert np.frombuffer(bpe.encode(t), dtype="<u4").tolist() == want.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 5, 60, 300, 900])))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "x y")]
    df = spark.createDataFrame([(d, t, 1, 1) for d, t in rows], "doc_id long, text string, length int, part int").repartition(3)
    got = packing.pack(df).collect()
    want, sequences, by = tokenizer(), defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    for d, t in dict(rows[:60]).items():
        ids = want.encode(t, add_special_tokens=False).ids + [2]
        own, at = sorted(by[d], key=lambda r: r.piece), 0
        for i, r in enumerate(own):
            part = struct.pack(f"<{r.length}I", *ids[at : at + r.length])
            assert (r.piece, r.start, r.ids_crc32, bytes(r.ids)) == (i, at, zlib.crc32(part), part) and (i == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
    assert [r.length for r in by[60]] == [1] and len(by[61]) == 2 and len(by[None]) == 1
    sizes = np.bincount([r.length for r in got], minlength=1025)
    assert len(sequences) <= sum(n for _, n in packing.best_fit(sizes))
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["uniform", "halves", "small", "full", "one", "none"])
def test_plans_hold_every_piece(case):
    rng = np.random.default_rng(1)
    n = {"uniform": rng.integers(1, 1025, 400), "halves": np.array([600] * 50 + [500] * 50), "small": rng.integers(1, 60, 5000), "full": np.full(9, 1024), "one": np.array([7]), "none": np.zeros(0, int)}[case]
    h = np.bincount(n, minlength=1025)
    planned, got = packing.plan(h), np.zeros(1025, dtype=int)
    for content, times in planned:
        assert sum(content) <= 1024
        for m, k in Counter(content).items():
            got[m] += k * times
    assert (got == h).all()
    used = sum(t for _, t in planned)
    assert used <= sum(t for _, t in packing.best_fit(h)) and used >= math.ceil(n.sum() / 1024)
    assert case != "small" or used <= math.ceil(n.sum() / 1024) + 1


def covered(h, solved):
    cover = np.zeros(1025)
    for held, times in solved:
        for m, k in held.items():
            cover[m] += times * k
    return (cover[1:] >= h[1:] * (1 - 1e-9)).all()


def held(plan):
    got = np.zeros(1025, dtype=np.int64)
    for content, times in plan:
        np.add.at(got, list(content), times)
    return got


def test_the_program_covers_every_length():
    h = np.random.default_rng(3).integers(500, 1500, 1025)
    h[0] = 0
    assert covered(h, packing.solve(h))
    placed, left = packing.rounded(h)
    assert (held(placed) + left == h).all() and left.sum() < h.sum() // 20


@pytest.mark.parametrize("sf, times", [("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 300)])
def test_the_program_packs_the_tables(spark, sf, times):
    """Every length of the table is covered; at full size nearly all pieces are placed by the program, near the bound of bytes."""
    rows = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).groupBy("length").count().collect()
    h = np.zeros(1025, dtype=np.int64)
    for r in rows:
        h[r["length"]] = times * r["count"]
    short = h.copy()
    short[1024] = 0
    assert covered(short, packing.solve(short))
    placed, left = packing.rounded(h)
    assert (held(placed) + left == h).all()
    planned = packing.plan(h)
    assert (held(planned) == h).all() and all(sum(c) <= 1024 for c, _ in planned)
    used, bytes_ = sum(n for _, n in planned), (h * np.arange(1025)).sum() / 1024
    assert used <= 1.01 * bytes_ + 1
    # rounding loses less than a sequence for each configuration that is used
    assert used <= 1.0005 * sum(n for _, n in packing.best_fit(h)) + 1
    assert times == 1 or left.sum() < 0.1 * short.sum()


def test_pricing_is_the_best_knapsack():
    worth = np.zeros(21)
    worth[[3, 5, 7]] = [2.0, 4.0, 6.5]
    value, held = packing.price(worth, 20)
    assert value == max(2 * a + 4 * b + 6.5 * c for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert sum(worth[n] * k for n, k in held.items()) == value


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("unseen", ["en", "fr"])
def test_unseen_languages_are_rejected(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = language.train(docs.where(F.col("lang") != unseen), ~held_out)
    asked = docs.where(held_out & language.has_letter(F.col("text")))
    found = language.identify(asked.select("text", "lang"), model).groupBy(F.col("lang") == unseen).agg(F.avg(F.col("rejected").cast("int"))).collect()
    share = dict(map(tuple, found))
    assert share[True] >= 0.8 and share[False] <= 0.03


def test_scores_are_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = catalog.op6_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = np.mean([r.lang == r.lang_pred for r in got])
    # the score allows for a share of texts in no learned language, of which there are none here
    assert right - language.UNSEEN - 0.02 <= np.mean([r.score for r in got]) <= right + 0.02
    assert len({r.score for r in got}) > len(got) // 2


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of a language " * 3, "en" if i % 50 else "fr") for i in range(5000)] + [(7, "x" * 400_000, "fr")], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SAMPLE_DOCS", 300)
    rows = language.sample(docs, F.lit(True)).collect()
    n = Counter(r.l for r in rows)
    assert 110 <= n["en"] <= 190 and n["fr"] == 100 and max(len(r.t) for r in rows) < 100
    copies = docs.where("doc_id = 7").unionAll(docs.where("doc_id = 7")).where("lang = 'en'")
    assert language.sample(copies, F.lit(True)).count() == 1 and language.sample(docs.limit(0), F.lit(True)).count() == 0


def test_language_of_odd_rows(spark):
    model = language.fit(["the cat and the dog went over there"] * 40 + ["le chat et les chiens sont partis déjà"] * 40, ["en"] * 40 + ["fr"] * 40)
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "the dog", "a"), (5, "les chiens", "b"), (5, "les chiens", None), (6, "x", None), (None, "the and " * 20000, "a")]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "fr", "en"]
    assert got[1].rejected and got[1].score == 0 and not got[4].rejected and got[6].lang_pred in ("en", "fr")
    assert language.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_archive_bytes():
    records = [warc.record(i, f"http://x/{i}", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None, False) for i in range(50)]
    words = warc.dictionary([b"sample"] * 3)
    data = warc.archive(records, words)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    assert list(warc.records(data)) == records
    head, block = warc.parse(records[7])
    assert head["warc-type"] == "response" and block == b"p" * 7
    for bad in (records[7][:-5] + b"\r\n\r\n", records[7].replace(b"p" * 7, b"q" * 7), records[7].replace(b"WARC/1.1", b"WARC/0.9"), records[7].replace(b"Content-Length: 7", b"Content-Length: 6")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises((ValueError, warc.zstandard.ZstdError)):
        list(warc.records(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.records(data[8:]))


def test_archives(spark, tmp_path):
    same, tiny = "<p>same</p>" * 20, "x" * 99
    rows = [(5, "u5", same), (3, "u 3", same), (9, None, same), (4, "u4", tiny), (6, "u6", tiny), (7, "u7", None), (8, "u8", ""), (None, "u", "é" * 50), (10, "v", "é" * 50), (5, "u5", same)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(p) >= 100 and i != first
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want) and ("None", 100, hashlib.sha256(("é" * 50).encode()).hexdigest(), "revisit", 10) in got
    none = spark.createDataFrame([(None, "u", same), (None, "u", same)], "page_id long, url string, html string")
    assert [(r.record_type, r.refers_to) for r in warc.round_trip(none).collect()] == [("response", None)] * 2
    warc.write_archives(df, str(tmp_path / "w"))
    back = warc.read_archives(spark.read.parquet(str(tmp_path / "w")))
    assert {r.page_id: bytes(r.payload).decode() for r in back.where("payload is not null").collect()}[3] == same
    assert warc.round_trip(df.limit(0)).count() == 0


def test_lattice_sums_over_all_segmentations():
    p = scoring.vocabulary()
    number = {int(k): int(n) for k, n in zip(p.keys, p.numbers, strict=True)}

    def brute(word):
        b = b" " + word
        total = [1.0] + [0.0] * len(b)
        for e in range(1, len(b) + 1):
            total[e] = total[e - 1] * math.exp(p.logp[b[e - 1]])
            for s in range(max(0, e - p.longest), e):
                if (n := number.get(scoring._hash(b[s:e]))) is not None:
                    total[e] += total[s] * math.exp(p.logp[n])
        return math.log(total[-1])

    words = [b"the", b"hello", "été".encode(), b"a", b"x" * 30, b"", b"\x00"]
    got, expected = scoring.word_logp(words, p, np.ones(len(words)))
    assert got == pytest.approx([brute(w) for w in words])
    assert expected.sum() > len(words) and abs(np.exp(p.logp).sum() - 1) < 1e-9
    assert scoring.word_logp([b"y" * 3000], p)[0][0] < -1000


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_scoring(spark, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    rows = [(i, t) for i, t in enumerate(["the cat", "The dog\tthe cat", None, "", "  ", "new words", "é\x00x the", "the " * 500, "a b"])] + [(1, "The dog\tthe cat"), (None, "the end")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, word string, rid int").repartition(2)
    learns = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)) | (F.col("doc_id") == 0)
    split = lambda t: re.findall("[^\x20\x09-\x0D]+", (t or "").translate(plain.LOW))
    counts, texts = Counter(), 0
    for d, t in rows:
        if d is not None and (d % 2 or d == 0):
            counts.update(split(t))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    counts[None] = texts
    found = scoring.score(df, learns).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for d, t in rows:
        own, r = [*split(t), None], by[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.score < 0
    assert by[2].score == pytest.approx(by[3].score) and by[5].score < by[3].score
    assert scoring.score(df.limit(0), learns).count() == 0


def test_score_is_that_of_all_segmentations(spark, monkeypatch):
    """EM and the sum over a document, against enumeration of every segmentation."""
    monkeypatch.setattr(scoring, "HEAD", 2)
    texts = {0: "the cat the dog", 1: "a the én", 2: "cats then at", 3: None, 4: "dog", 6: "zq the"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    start = scoring.vocabulary()
    number = {int(k): int(n) for k, n in zip(start.keys, start.numbers, strict=True)}

    def segmentations(b):
        if not b:
            yield []
        for n in range(1, len(b) + 1):
            own = [b[0]] if n == 1 else []
            if (found := number.get(scoring._hash(b[:n]))) is not None:
                own.append(found)
            for rest in segmentations(b[n:]) if own else ():
                for x in own:
                    yield [x, *rest]

    ways = {w: list(segmentations(b" " + w.encode())) for t in texts.values() for w in (t or "").split()}
    counts = Counter(w for d, t in texts.items() if d % 5 != 1 for w in (t or "").split())
    docs_ = sum(d % 5 != 1 for d in texts)
    p, seen = np.exp(start.logp), []
    total = sum(counts.values()) + docs_
    for _ in range(scoring.ROUNDS):
        expected, logp = np.full(len(p), 0.01), 0.0
        expected[-1] += docs_
        for w, c in counts.items():
            chance = [np.prod(p[x]) for x in ways[w]]
            logp += c * math.log(sum(chance))
            for x, q in zip(ways[w], chance, strict=True):
                np.add.at(expected, x, c * q / sum(chance))
        p = expected / expected.sum()
        seen.append(logp / total)
        if len(seen) > 1 and seen[-1] - seen[-2] < scoring.GAIN:
            break
    assert seen == sorted(seen)
    got = {r.doc_id: r.score for r in scoring.score(df, F.col("doc_id") % 5 != 1).collect()}
    for d, t in texts.items():
        want = math.log10(p[-1]) + sum(math.log10(sum(np.prod(p[x]) for x in ways[w])) for w in (t or "").split())
        assert got[d] == pytest.approx(want, rel=1e-9)


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(str(i), t) for i, t in enumerate([1] * 50 + [2] * 9 + [100, 1000, 1001])], "word string, t long")
    assert [scoring.frequent(words, n) for n in (62, 61, 12, 11, 3, 2, 1)] == [1, 2, 2, 100, 100, 1000, 1 << 62]


def test_pipeline(spark, corpus):
    import corpus_pipeline as c

    from seriesloom.llm import pii

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = df.columns, {}
    for name, stage in c.STAGES:
        df = stage(spark, df, SF).cache()
        seen[name] = {r.doc_id: r for r in df.collect()}
        assert name == c.STAGES[-1][0] or df.columns == columns
    texts = {d: t for d, t in corpus.items() if any(ch.isalpha() for ch in t or "")}
    assert set(seen["language_id"]) == set(texts)
    classes = plain.classes(texts.items())
    kept = {d for d in texts if d not in classes or classes[d][0] == d}
    assert set(seen["jaccard_join"]) == kept
    clean = {d for d in kept if not plain.contamination(corpus[d], items)[3]}
    assert set(seen["benchmark_decontamination"]) == clean
    assert set(seen["pii_redaction"]) == clean
    for d, r in seen["pii_redaction"].items():
        if not plain.personal(corpus[d]):
            assert "[EMAIL]" not in r.text and "[CARD]" not in r.text
        else:
            assert not [x for x in plain.personal(r.text) if x[1] in (0, 3)]
        assert r.n_chars == len(r.text) or r.text == corpus[d]
    assert {r for r in seen["best_fit_packing"]} == clean and list(pii.BASE)


def test_files_are_decoded_by_what_they_hold(monkeypatch):
    """Files of one repeated letter are far shorter than their texts; no more than CHUNK bytes are decoded side by side."""
    from types import SimpleNamespace

    import pyarrow as pa

    got = []
    decode = flac.decode
    monkeypatch.setattr(flac, "decode", lambda files: got.append(decode(files)) or got[-1])
    run = flac.media_digest(SimpleNamespace(dtypes=[("doc_id", "bigint")], mapInArrow=lambda run, schema: run))
    texts = ["a" * 400_000] * 9
    files = flac.encode([flac.payload(t) for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([400_000] * 9, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
    assert sum(map(len, files)) < 400_000
    assert sum(len(b) for b in run(iter([batch]))) == 9 and max(sum(map(len, x)) for x in got) <= 1 << 20
