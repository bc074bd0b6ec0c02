"""Personal data by weak supervision, in DataFrame functions only.

Base spans are exact patterns. Beyond them, looser candidates are voted on by three labelers (regex,
gazetteer, context); expectation-maximisation over the counts of vote patterns of all documents estimates
each labeler's reliability, and a logistic classifier of span features, fitted to the posteriors, decides.
The counts have one row for each combination of ten flags, so the driver sees a bounded table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The base patterns. Possessive loops match the same texts as the greedy ones and
# neither recurse nor backtrack; the look-behinds skip places where a leftmost match cannot begin.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?=(?:[ -]?[0-9]){11})(?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for its pattern to be tried.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10}", "phone": r"\+[0-9]"}

# Looser candidates, the gazetteer and the words of a context.
LOOSE = (
    r"(?<![A-Za-z0-9@._+/-])(?:@[A-Za-z0-9_]{3,}"  # handles
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"  # account numbers
    r"|(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ)[A-Za-z0-9_.=/+-]{12,}+"  # keys by their first letters
    r"|[A-Za-z0-9_]{20,}+"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    r"|\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{9,19}+(?![0-9])"
    r"|(?<=[=:] ?[\"']?)(?=[^\s\"']*[0-9])[^\s\"',;]{6,64}+"  # what is assigned and has a digit
    r"|(?<=\b(?:Mr|Mrs|Ms|Dr|Prof)\.? )[A-Z][a-z]+(?: [A-Z][a-z]+)?)"  # names by title
)
LOOSE_GATE = r"@[A-Za-z0-9_]|[A-Za-z0-9_]{20}|[0-9]{3}[ .-][0-9]{4}|[0-9]{9}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[0-9]{3}-[0-9]{2}-|[=:] ?[\"']?[^\s\"']*[0-9]|(?:sk|pk|rk|gh[pos]|glpat|xox[abp]|A[KS]IA|AIza|eyJ)[A-Za-z0-9_.=/+-]{12}|\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]"
GAZETTEER = r"^(?:sk|pk|rk)[_-]|^gh[pos]_|^glpat-|^xox[abp]-|^A[KS]IA[0-9A-Z]|^AIza|^eyJ|^\(?(?:555|800|900)\b|^(?:4[0-9]|5[1-5]|34|37|6011)[0-9]{11,17}$|^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PL|PT|IE|SE|DK|FI|NO)[0-9]{2}"
CONTEXT = "phone|tel|call|mobile|fax|contact|card|account|iban|bank|token|key|secret|password|passwd|pwd|pass|login|user|username|ssn|social security|passport|license|api|auth|bearer|credential|born|name|mr|mrs|ms|dr|prof|from"
#: Characters before a candidate in which a word of CONTEXT counts.
NEAR = 24
LABELERS = ["regex", "gazetteer", "context"]
FEATURES = [*LABELERS, "long", "digits_only", "mixed", "assigned", "quoted", "checked", "varied"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass Luhn's check; doubled from the second last on."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)),
    )
    return total % 10 == 0


def _mod97(account: Column) -> Column:
    """Whether an international account number leaves 1 by 97: its first four signs go last, letters count from 10."""
    flat = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(flat)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, keep, extra: list | None = None) -> Column:
    """Array of structs start, end (code points; end exclusive) and m of the matches that keep() holds for.

    split() gives the pieces between matches, so a match begins where the pieces and matches before it end.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s")
    )

    def spans(p: Column) -> Column:
        def length(a: Column, n: Column) -> Column:
            return F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, y: x + F.length(y))

        chosen = F.filter(F.sequence(F.lit(0), F.size(p["m"]) - 1), lambda i: keep(F.get(p["m"], i)))
        start = lambda i: length(p["s"], i + 1) + length(p["m"], i)
        made = F.transform(chosen, lambda i: F.struct(start(i).alias("start"), F.get(p["m"], i).alias("m"), F.right(F.get(p["s"], i), F.lit(NEAR)).alias("left")))
        return F.transform(made, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["left"].alias("left")))

    one = F.transform(F.array(parts), lambda p: F.when(F.size(p["m"]) > 0, spans(p)).otherwise(F.array().cast(SPANS)))
    return F.element_at(one, 1)


SPANS = "array<struct<start:int,end:int,m:string,left:string>>"


def base_spans(text: Column, kind: str) -> Column:
    empty = F.array().cast(SPANS)
    return F.when(text.rlike(GATE[kind]), _matches(text, BASE[kind], lambda m: _valid(kind, m))).otherwise(empty)


def _flags(x: Column) -> Column:
    """A candidate's votes and features, all 0 or 1."""
    m, left = x["m"], x["left"]
    n, mixed = F.length(_digits(m)), m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    account = m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,32}$")
    flag = {
        "regex": m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$|^[0-9]{13,16}$|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|^A[KS]IA[0-9A-Z]{16}$") | account,
        "gazetteer": m.rlike(GAZETTEER),
        "context": left.rlike(rf"(?i)\b(?:{CONTEXT})\b"),
        "long": F.length(m) >= 20,
        "digits_only": n == F.length(m),
        "mixed": mixed,
        "assigned": left.rlike("[=:][ \"']*$"),
        "quoted": left.rlike("[\"']$"),
        # its own check holds: an account's modulo 97, a card's Luhn
        "checked": F.when(account, _mod97(m)).otherwise(F.when(m.rlike("^[0-9]{12,19}$"), _luhn(m)).otherwise(False)),
        # of random letters and digits few repeat; words and counts repeat more
        "varied": mixed & (F.size(F.array_distinct(F.split(F.substring(m, 1, 32), ""))) >= 0.34 * F.least(F.length(m), F.lit(32))),
    }
    return F.struct(*(v.cast("int").alias(k) for k, v in flag.items()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: base spans by kind and candidates (start, end, flags) clear of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    told = told.select(
        "doc_id",
        *(F.transform(base_spans(F.col("text"), k), lambda x, k=k: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"))).alias(k) for i, k in enumerate(BASE)),
        F.when(F.col("text").rlike(LOOSE_GATE), _matches(F.col("text"), LOOSE, lambda m: F.lit(True))).otherwise(F.array().cast(SPANS)).alias("loose"),
    )
    clear = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return told.withColumn("base", F.array_sort(F.concat(*BASE))).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        "base",
        F.transform(clear, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _flags(x).alias("f"))).alias("loose"),
    )


def reliabilities(votes: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Expectation-maximisation for a hidden class under independent labelers.

    votes: counts of each pattern. Returns the class's probability given each pattern, and each labeler's rates of
    a vote given the class and given its absence. Begins from the share of votes; counts are smoothed by one.
    """
    post = {p: (1 + sum(p)) / (2 + len(p)) for p in votes}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        yes = sum(n * post[p] for p, n in votes.items())
        no = sum(n * (1 - post[p]) for p, n in votes.items())
        prior = (yes + 1) / (yes + no + 2)
        rates = [
            (
                (sum(n * post[p] for p, n in votes.items() if p[j]) + 1) / (yes + 2),
                (sum(n * (1 - post[p]) for p, n in votes.items() if p[j]) + 1) / (no + 2),
            )
            for j in range(len(next(iter(votes), ())))
        ]
        for p in votes:
            odds = math.log(prior / (1 - prior))
            for v, (a, b) in zip(p, rates, strict=True):
                odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post, rates


def fit_classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 400) -> list[float]:
    """Logistic weights, bias first, fitted to soft labels of feature patterns by gradient descent."""
    total = sum(n for _, _, n in rows)
    w = [0.0] * (1 + len(FEATURES))
    for _ in range(rounds if total else 0):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-(w[0] + sum(a for a, v in zip(w[1:], x, strict=True) if v))))
            e = (p - y) * n / total
            g[0] += e
            for j, v in enumerate(x):
                if v:
                    g[j + 1] += e
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base and spans.

    base and spans are arrays of (start, rank, end), sorted; rank is the kind's place in BASE, or 4 for a span
    that the classifier added. Null text: no spans. Repeated rows each get a row; an empty table gives none.
    Other columns are ignored.
    """
    found = cut(scan(docs, id_col, text_col))
    # one row at most for each combination of the flags
    flags = found.select(F.explode("loose.f").alias("f")).select("f.*").groupBy(*FEATURES).count().collect()
    patterns = [(tuple(r[k] for k in FEATURES), r["count"]) for r in flags]
    votes: dict[tuple[int, ...], int] = {}
    for x, n in patterns:
        votes[x[: len(LABELERS)]] = votes.get(x[: len(LABELERS)], 0) + n
    post, _ = reliabilities(votes)
    w = fit_classifier(sorted((x, post[x[: len(LABELERS)]], n) for x, n in patterns))
    score = lambda f: reduce(lambda a, b: a + b, [F.lit(a) * f[k] for a, k in zip(w[1:], FEATURES, strict=True)], F.lit(w[0]))
    bar = math.log(threshold / (1 - threshold))
    added = F.transform(
        F.filter("loose", lambda x: score(x["f"]) > bar),
        lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), x["end"].alias("end")),
    )
    return found.select(
        "doc_id", *(f"n_{k}" for k in BASE), "base", F.array_sort(F.concat("base", added)).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, [*BASE, "other"]))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by the first one's kind in brackets; spans are sorted by start."""
    kinds = F.array(*map(F.lit, [f"[{k.upper()}]" for k in [*BASE, "other"]]))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["end"], F.struct(F.greatest(a["end"], x["end"]).alias("end"), a["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("end"), F.concat(a["out"], F.array(F.substring(text, a["end"] + 1, x["start"] - a["end"]), F.get(kinds, x["rank"]))).alias("out"))
    )
    return F.aggregate(
        spans, empty, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["end"] + 1, F.length(text)))
    )
