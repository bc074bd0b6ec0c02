"""Scalar functions: labels, JSON and text, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    return F.format_string("%02d:%02d:%06.3f", h, m, F.pmod(seconds, F.lit(60.0)))


def quantize(x: Column) -> Column:
    """x in 0..1 as 0..255, cut."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255)))


def argmax(values: Column) -> Column:
    """Place, from 0, of the first largest element; null for an empty or null array."""
    return F.array_position(values, F.array_max(values)) - F.when(F.size(values) > 0, 1)


def top_k(values: Column, k: int) -> Column:
    """The k largest elements as structs i (from 0) and v, first ones first among equals."""
    found = F.transform(values, lambda v, i: F.struct((-v).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(found), 1, k), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))


def mass(values: Column, first: int, n: int) -> Column:
    """Sum of n elements from `first` (from 0), as double."""
    return F.aggregate(F.slice(values, first + 1, n), F.lit(0.0), lambda a, x: a + x)


def side_of(label: Column, top: list[str], bottom: list[str]) -> Column:
    return F.when(label.isin(top), "top").when(label.isin(bottom), "bottom")


def strip_prefix(label: Column, prefixes: list[str]) -> Column:
    """label without the first of the prefixes that it begins with."""
    out = label
    for p in reversed(prefixes):
        out = F.when(label.startswith(p), F.substring(label, len(p) + 1, F.length(label))).otherwise(out)
    return out


def probability_label(values: Column, names: list[str], unknown: int) -> tuple[Column, Column]:
    """Name of the largest class (null for `unknown`) and its probability."""
    i = argmax(values)
    return F.when(i != unknown, F.get(F.array(*map(F.lit, names)), i.cast("int"))), F.array_max(values)


def lenient_int(text: Column) -> Column:
    """Whole number in a text, or null; "3.7" is none."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("int"))


def truncated_int(number: Column) -> Column:
    """A number without its fraction."""
    return number.try_cast("int")


def lenient_ints(texts: Column) -> Column:
    return F.coalesce(F.filter(F.transform(texts, lenient_int), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def without_fences(text: Column) -> Column:
    """Lines that don't begin with ```."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: ~F.ltrim(x).startswith("```"))
    return F.array_join(lines, "\n")


def salvage_array(text: Column, key: str) -> Column:
    """The whole numbers of a JSON array under a key, also of one that is cut off; null if the key isn't there."""
    inner = F.regexp_extract(text, rf'"{key}"\s*:\s*\[([^\]]*)', 1)
    found = F.transform(F.regexp_extract_all(inner, F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.when(text.rlike(rf'"{key}"\s*:\s*\['), found)


def last_of(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def scores(text: Column) -> tuple[Column, Column]:
    """The current game's scores of a model's answer: the last of all_a and all_b, or score_a and score_b."""
    clean = without_fences(text)
    flat = lambda k: lenient_int(F.regexp_extract(clean, rf'"{k}"\s*:\s*(-?[0-9]+)', 1))
    return tuple(F.coalesce(last_of(salvage_array(clean, f"all_{k}")), flat(f"score_{k}")) for k in ("a", "b"))


def attempts(found: Column) -> Column:
    """An array of structs m, a, b as "m:a:b; ..."; nulls are written as None."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["m"], word(x["a"]), word(x["b"]))), "; ")


def joined_flags(**flags: Column) -> Column:
    """Names of the flags that hold, in order, with + between."""
    return F.concat_ws("+", *(F.when(v, F.lit(k)) for k, v in flags.items()))


def fingerprint(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def spaced(start: Column, end: Column, n: Column) -> Column:
    """n whole numbers evenly from start to end, both included, without repeats; start if n is 1."""
    step = (end - start) / F.nullif(n - 1, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.floor(start + i * F.coalesce(step, F.lit(0.0)))))


def triangular_weights(n: int) -> list[float]:
    """Weights that rise to the middle and fall, summing to 1."""
    w = [min(i + 1, n - i) for i in range(n)]
    return [x / sum(w) for x in w]


def score_jump(a: Column, b: Column, before_a: Column, before_b: Column) -> Column:
    """Not 0:0, neither score fell, and both rose by 2 together at least."""
    da, db = a - before_a, b - before_b
    return F.coalesce(~((a == 0) & (b == 0)) & (da >= 0) & (db >= 0) & (da + db >= 2), F.lit(False))


def break_score(a: Column, b: Column) -> Column:
    return ((a == 0) & (b == 0)) | ((F.greatest(a, b) == 11) & (F.least(a, b) < 11))
