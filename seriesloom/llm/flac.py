"""FLAC for columns of 8-bit mono samples: frames are coded and decoded side by side in numpy.

A file is "fLaC", STREAMINFO (with the MD5 of the samples), a SEEKTABLE with a point for every frame, and
frames of BLOCK samples (the last may be shorter). A frame holds one subframe (constant, verbatim, fixed
or linear predictor with Rice-coded residuals), a CRC-8 of its header and a CRC-16 of the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE, PRECISION = 1024, 8000, 12
#: Bytes of samples that are coded side by side.
CHUNK = 1 << 20


_TABLES: dict[int, np.ndarray] = {}


def _distances(bits: int, length: int) -> np.ndarray:
    """What a byte adds to a CRC over which so many more bytes pass: [distance, byte]."""
    poly, mask = {8: 0x07, 16: 0x8005}[bits], (1 << bits) - 1
    known = _TABLES.get(bits)
    if known is None or len(known) < length:
        c = np.arange(256, dtype=np.int64) << (bits - 8)
        rows = []
        for _ in range(max(length, 1200)):
            for _ in range(8):
                c = np.where(c >> (bits - 1) & 1, c << 1 ^ poly, c << 1) & mask
            rows.append(c)
        known = _TABLES[bits] = np.array(rows, dtype=np.uint16)
    return known


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each range of data, none empty: the exclusive or of what its bytes add."""
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first, length).astype(np.int32)
    table = _distances(bits, int(length.max(initial=1)))
    left = np.repeat(length - 1, length).astype(np.int32) - within
    added = table.ravel()[(left << 8) | data[np.repeat(start, length) + within]]
    return np.bitwise_xor.reduceat(added, first).astype(np.int64)


def _numbers(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in UTF-8's form: up to four bytes and how many."""
    out, size = np.zeros((len(frame), 4), dtype=np.uint8), 1 + (frame >= 1 << 7) + (frame >= 1 << 11) + (frame >= 1 << 16)
    for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = size == n
        v = frame[own]
        out[own, 0] = lead | v >> 6 * (n - 1)
        for j in range(1, n):
            out[own, j] = 0x80 | v >> 6 * (n - 1 - j) & 63
    return out, size


def _fixed(x: np.ndarray, order: int) -> np.ndarray:
    """Residuals of a fixed predictor; the first `order` columns mean nothing."""
    for _ in range(order):
        x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
    return x


def _linear(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second-order linear prediction by autocorrelation: quantised coefficients, shifts and residuals."""
    y = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", y[:, k:], y[:, : y.shape[1] - k]) for k in range(3))
    r0, r1, r2 = (r.astype(np.float64) for r in (r0, r1, r2))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    c = np.clip(np.stack([(r0 * r1 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], axis=1), -3.9, 3.9)
    shift = np.full(len(x), 9)
    q = np.rint(c * (1 << 9)).astype(np.int32)
    e = x.copy()
    e[:, 2:] = x[:, 2:] - ((q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> 9)
    return q, shift, e


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload of 1 byte at least; a byte b is the sample b - 128."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    frames = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(of)) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(BLOCK, sizes[of] - number * BLOCK)
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    start = (np.cumsum(sizes) - sizes)[of] + number * BLOCK
    column = np.arange(BLOCK)
    inside = column < n[:, None]
    x = np.where(inside, np.pad(raw, (0, BLOCK))[start[:, None] + column].astype(np.int32) - 128, 0)

    # the cheapest of the predictors, by exact bits for one Rice parameter each
    q, shift, lin = _linear(x, n)
    best = np.full(len(n), 1 << 60)
    kind, order, rice = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    code = np.zeros_like(x)
    for what, o, e in [("fixed", 0, x), ("fixed", 1, _fixed(x, 1)), ("fixed", 2, _fixed(x, 2)), ("linear", 2, lin)]:
        u = np.where(inside & (column >= o), (e << 1) ^ (e >> 31), 0)
        mean = u.sum(axis=1) / np.maximum(n - o, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.75)), 0, 14).astype(np.int64)
        bits = (u >> k[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64) + (n - o) * (1 + k) + 10 + 8 * o + (9 + PRECISION * o if what == "linear" else 0)
        better = (bits < best) & (n > o)
        best = np.where(better, bits, best)
        kind[better], order[better], rice[better] = 2 if what == "fixed" else 3, o, k[better]
        code[better] = u[better]
    flat = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    kind[best >= 8 * n], best = 1, np.minimum(best, 8 * n)
    kind[flat], best = 0, np.where(flat, 8, best)

    names, name_len = _numbers(number)
    short = n != BLOCK
    head_len = 5 + name_len + 2 * short
    total = head_len + (8 + best + 7) // 8 + 2
    at = np.cumsum(total) - total
    body = (at + head_len) * 8
    numbers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(where: np.ndarray, value: np.ndarray, width: int | np.ndarray) -> None:
        """Notes numbers of up to 17 bits for places in bits."""
        numbers.append((where, value, np.broadcast_to(width, where.shape)))

    predicted = kind >= 2
    put(body, np.choose(kind, [0, 1, 8 + order, 32 + order - 1]) << 1, 8)
    put(body[flat] + 8, x[flat, 0] & 255, 8)
    for j in range(2):
        own = predicted & (order > j)
        put(body[own] + 8 + 8 * j, x[own, j] & 255, 8)
    own = kind == 3
    where = body + 8 + 8 * order
    put(where[own], np.full(own.sum(), PRECISION - 1), 4)
    put(where[own] + 4, shift[own], 5)
    for j in range(2):
        put(where[own] + 9 + PRECISION * j, q[own, j] & (1 << PRECISION) - 1, PRECISION)
    where += np.where(own, 9 + 2 * PRECISION, 0)
    put(where[predicted] + 6, rice[predicted], 4)
    # a Rice code is zeros, a one and the low bits: only the latter two are put
    coded = predicted[:, None] & inside & (column >= order[:, None])
    k = rice[:, None].astype(np.int32)
    width = np.where(coded, (code >> k) + 1 + k, 0)
    after = ((where + 10)[:, None] + np.cumsum(width, axis=1, dtype=np.int32))[coded]
    k = np.broadcast_to(k, code.shape)[coded]
    put(after - k - 1, code[coded] & (1 << k) - 1 | 1 << k, k + 1)
    where, value, width = (np.concatenate(x) for x in zip(*numbers, strict=True))
    spread = value.astype(np.int64) << (24 - (where & 7) - width)  # over three bytes
    spot, size = where >> 3, int(total.sum())
    out = sum(np.bincount(spot + j, spread >> (16 - 8 * j) & 255, size + 3) for j in range(3))[:size].astype(np.uint8)
    for i in np.nonzero(kind == 1)[0]:
        a = at[i] + head_len[i] + 1
        out[a : a + n[i]] = x[i, : n[i]] & 255

    out[at], out[at + 1], out[at + 2], out[at + 3] = 0xFF, 0xF8, np.where(short, 0x70, 0xA0), 0x02
    for j in range(4):
        has = name_len > j
        out[at[has] + 4 + j] = names[has, j]
    out[(at + 4 + name_len)[short]], out[(at + 5 + name_len)[short]] = n[short] - 1 >> 8, n[short] - 1 & 255
    out[at + head_len - 1] = crcs(out, at, head_len - 1, 8)
    end = at + total - 2
    check = crcs(out, at, total - 2, 16)
    out[end], out[end + 1] = check >> 8, check & 255

    files, pcm, done = [], (raw ^ 0x80).tobytes(), 0
    for i, m in enumerate(frames):
        own = slice(done, done + int(m))
        a, z = int(at[own][0]), int(at[own][-1] + total[own][-1])
        md5 = hashlib.md5(pcm[int(start[done]) : int(start[done] + sizes[i])]).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(total[own].min()).to_bytes(3, "big") + int(total[own].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(sizes[i])).to_bytes(8, "big") + md5
        points = np.zeros(int(m), dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        points["sample"], points["byte"], points["n"] = number[own] * BLOCK, at[own] - a, n[own]
        seek = points.tobytes()
        files.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + out[a:z].tobytes())
        done += int(m)
    return files


def _blocks(file: bytes) -> tuple[int, list[int], int, bytes]:
    """Where the audio begins, the frames' offsets from there, the number of samples and their MD5."""
    if file[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, offsets, total, md5 = 4, False, [], 0, b""
    while not last:
        last, kind, size = bool(file[at] & 128), file[at] & 127, int.from_bytes(file[at + 1 : at + 4], "big")
        data = file[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(data[10:18], "big")
            total, md5 = packed & (1 << 36) - 1, data[18:34]
            if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
                raise ValueError("only mono streams of 8 bits are decoded")
        elif kind == 3:
            offsets = [int(x) for x in np.frombuffer(data, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])["byte"]]
        at += 4 + size
    return at, offsets, total, md5


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each file, as bytes 0 to 255. Raises ValueError where a checksum, a frame's number or the MD5 is wrong."""
    parsed = [_blocks(f) for f in files]
    data = np.frombuffer(b"".join(files) + bytes(24), dtype=np.uint8)
    base = np.cumsum([0] + [len(f) for f in files])
    at = np.concatenate([base[i] + p[0] + np.array(p[1], dtype=np.int64) for i, p in enumerate(parsed)])
    of = np.repeat(np.arange(len(files)), [len(p[1]) for p in parsed])
    number = np.arange(len(of)) - np.searchsorted(of, of)
    end = np.append(at[1:], 0)
    end[np.append(of[1:] != of[:-1], True)] = base[1:]

    names, name_len = _numbers(number)
    short = data[at + 2] >> 4 == 7
    head = 5 + name_len + 2 * short
    n = np.where(short, (data[at + 4 + name_len].astype(np.int64) << 8 | data[at + 5 + name_len]) + 1, BLOCK)
    named = all((data[at + 4 + j] == names[:, j])[name_len > j].all() for j in range(4))
    if not named or (data[at] != 0xFF).any() or (data[at + 1] != 0xF8).any() or not np.isin(data[at + 2] >> 4, [7, 10]).all():
        raise ValueError("a frame is missing or its header is damaged")
    if (crcs(data, at, head - 1, 8) != data[at + head - 1]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    if (crcs(data, at, end - at - 2, 16) != (data[end - 2].astype(np.int64) << 8 | data[end - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")

    # the 64 bits from every byte on
    rows = len(data) // 8 - 1
    window = np.empty((rows, 8), dtype=np.uint64)
    for j in range(8):
        window[:, j] = np.frombuffer(data, dtype=">u8", count=rows, offset=j)
    window = window.reshape(-1)

    def get(p: np.ndarray, width: int) -> np.ndarray:
        """Unsigned numbers of up to 56 bits."""
        return (window[p >> 3] << (p & 7).astype(np.uint64) >> np.uint64(64 - width)).astype(np.int64)

    def signed(p: np.ndarray, width: int) -> np.ndarray:
        v = get(p, width)
        return v - (v >> width - 1 << width)

    x = np.zeros((len(at), BLOCK), dtype=np.int64)
    bit = (at + head) * 8
    what = get(bit, 8) >> 1
    bit += 8
    fixed, linear = (what >= 8) & (what <= 12), what >= 32
    order = np.where(fixed, what - 8, np.where(linear, what - 31, 0))
    for i in np.nonzero(what == 0)[0]:
        x[i, : n[i]] = signed(bit[i : i + 1], 8)
    for i in np.nonzero(what == 1)[0]:
        x[i, : n[i]] = data[bit[i] >> 3 : (bit[i] >> 3) + n[i]].view(np.int8)
    rest = np.nonzero(fixed | linear)[0]
    if len(rest) != (what > 1).sum():
        raise ValueError("a reserved kind of subframe")
    rest = rest[np.argsort(order[rest] - n[rest], kind="stable")]  # most residuals first
    p, o, m = bit[rest], order[rest], n[rest]
    warm = np.zeros((len(rest), int(o.max(initial=0)) + 1), dtype=np.int64)
    for j in range(warm.shape[1] - 1):
        warm[o > j, j] = signed(p[o > j] + 8 * j, 8)
    p = p + 8 * o
    lin = linear[rest]
    coef, shift = np.zeros((len(rest), warm.shape[1]), dtype=np.int64), np.zeros(len(rest), dtype=np.int64)
    if lin.any():
        width = get(p[lin], 4) + 1
        if (width != PRECISION).any():
            raise ValueError(f"only coefficients of {PRECISION} bits are decoded")
        shift[lin] = get(p[lin] + 4, 5)
        for j in range(warm.shape[1] - 1):
            has = lin & (o > j)
            coef[has, j] = signed(p[has] + 9 + PRECISION * j, PRECISION)
        p = p + np.where(lin, 9 + PRECISION * o, 0)
    if (get(p, 6) != 0).any():
        raise ValueError("only one partition of 4-bit Rice parameters is decoded")
    k = get(p + 6, 4)
    p = p + 10

    # Rice codes: one code of every frame at a time
    codes = np.zeros((BLOCK, len(rest)), dtype=np.int64)
    live = np.searchsorted(o - m, -np.arange(int((m - o).max(initial=0))), side="left")
    left = np.uint64(63) - k.astype(np.uint64)
    for j, c in enumerate(live):
        q, own = p[:c], k[:c]
        v = window[q >> 3] << (q & 7).astype(np.uint64)
        extra = 0
        if not (v >> np.uint64(11)).all():  # a long run of zeros
            extra = np.zeros(c, dtype=np.int64)
            q = q.copy()
            while (zero := v >> np.uint64(11) == 0).any():
                q[zero], extra[zero] = q[zero] + 40, extra[zero] + 40
                v[zero] = window[q[zero] >> 3] << (q[zero] & 7).astype(np.uint64)
        zeros = 1075 - ((v >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
        q = q + zeros + 1
        low = (window[q >> 3] << (q & 7).astype(np.uint64) >> np.uint64(1) >> left[:c]).astype(np.int64)
        codes[j, :c] = (zeros + extra << own) | low
        p[:c] = q + own
    e = ((codes >> 1) ^ -(codes & 1)).T
    for a in range(int(o.max(initial=0)) + 1):
        own = np.nonzero((o == a) & ~lin)[0]
        if len(own):
            # an order is undone by a sum; each begins from the last difference of the first samples
            y, first = e[own, : BLOCK - a], warm[own, :a]
            for b in range(a, 0, -1):
                d = first
                for _ in range(b - 1):
                    d = np.diff(d, axis=1)
                y = np.cumsum(np.concatenate([d[:, -1:], y], axis=1), axis=1)[:, 1:]
            x[rest[own], a:] = y
            x[rest[own], :a] = first
    if lin.any():
        own = np.nonzero(lin)[0]
        top = int(o[own].max())
        y = np.zeros((top + BLOCK, len(own)), dtype=np.int64)  # each column ends its first samples at row top
        res, c, s, oo = e[own].T, coef[own].T, shift[own], o[own]
        for j in range(top):
            has = oo > j
            y[top - oo[has] + j, has] = warm[own][has, j]
        for t in range(int((m - o)[own].max())):
            y[top + t] = res[t] + ((sum(c[j] * y[top + t - 1 - j] for j in range(top))) >> s)
        for a in np.unique(oo):
            has = oo == a
            x[rest[own[has]]] = y[top - a : top - a + BLOCK, has].T
    out, done = [], 0
    pcm = (x + 128).astype(np.uint8)
    for f, (_, offsets, total, md5) in zip(files, parsed, strict=True):
        rows = slice(done, done + len(offsets))
        done += len(offsets)
        if int(n[rows].sum()) != total:
            raise ValueError("frames are missing")
        own = pcm[rows].reshape(-1)[:total]
        if hashlib.md5((own ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 is wrong")
        out.append(own)
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 padded with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def feature(samples: np.ndarray) -> str:
    """Peak, energy, zero crossings and mean step of the samples about 128, from exact sums."""
    s = samples.astype(np.int64) - 128
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"peak={int(np.abs(s).max())};energy={int((s * s).sum())};crossings={crossings};steps={int(np.abs(np.diff(s)).sum())}"


def _chunks(sizes: list[int]) -> Iterator[slice]:
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if sizes:
        yield slice(first, len(sizes))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's FLAC file.

    Null text: like the empty one, 64 zero bytes. Repeated rows each get a file; equal texts get equal files.
    An empty table gives none. Other columns are ignored.
    """
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.binary_length(b.column("text")).fill_null(0)
            for s in _chunks(size.to_pylist()):
                own = b.slice(s.start, s.stop - s.start)
                media = encode([payload(t) for t in own.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), size[s].cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return told.mapInArrow(run, f"doc_id {dict(told.dtypes)['doc_id']}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, block: int = 16 * BLOCK) -> DataFrame:
    """The decoded samples of a media column in blocks: doc_id, sample (the block's first) and pcm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            for s in _chunks([len(f) for f in files]):
                ids, at, pcm = [], [], []
                for i, x in enumerate(decode(files[s])):
                    for a in range(0, len(x), block):
                        ids.append(s.start + i)
                        at.append(a)
                        pcm.append(x[a : a + block].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids)), pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "sample", "pcm"])

    return media.mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, sample long, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads each file back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _chunks(b.column("n_bytes").to_pylist()):  # what is decoded, which a file may be far shorter than
                files, rows = b.column("media")[s].to_pylist(), []
                for f, x in zip(files, decode(files), strict=True):
                    data = x.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(x)))
                own = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *map(pa.array, zip(*rows, strict=True))], names)

    schema = f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)
