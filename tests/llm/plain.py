"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(text, items):
    """n_words, n_hit, ids, contaminated; items: (id, text)."""
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            wins[tuple(w[k : k + 13])].add(str(i))
    w, hit, found = words(text), set(), set()
    for n in {len(x) for x in wins}:
        for k in range(len(w) - n + 1):
            if own := wins.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= own
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """(start, kind's place, end), sorted."""
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """doc_id: (class_id, n_links) of the rows (doc_id, text) that have words."""
    sets = {d: shingles(t) for d, t in rows if d is not None and shingles(t)}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    ids = sorted(set(rep.values()))
    root, links = {r: r for r in ids}, dict.fromkeys(ids, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(rep[s]), links[rep[s]]) for d, s in sets.items()}
