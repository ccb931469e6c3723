"""String, hash and set functions on columns; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the min-hash family.
PRIME = 1_000_000_007


def normalise(text: Column, keep: str = "") -> Column:
    """Lower case, anything but letters, digits, `_`, white space and `keep` becomes a space, white space collapses and is trimmed."""
    spaced = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_\s{keep}]", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def leading_sentences(text: Column, n: int = 3) -> Column:
    """The first n non-blank sentences (split at full stops), padded with empty strings; null text gives only padding."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def once(value: Column, f) -> Column:
    """f of a value that is computed once, where f uses it within a lambda function."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct k-token shingles; a shorter list is one shingle, an empty one has none."""
    many = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
    return once(tokens, lambda t: F.when(F.size(t) > 0, F.array_distinct(many(t))).otherwise(F.array().cast("array<string>")))


def small_hash(text: Column) -> Column:
    """A 28-bit integer from the MD5 of a string; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def minhash(shingle_list: Column, slots: int = 32) -> Column:
    """Signature slots min((7i + 13) * h + 11i + 17 mod PRIME); an empty set has zeros."""
    one = lambda hashed, i: F.array_min(F.transform(hashed, lambda h: ((7 * i + 13) * h + (11 * i + 17)) % F.lit(PRIME)))
    slot = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    return once(F.transform(shingle_list, small_hash), lambda hashed: F.transform(slot, lambda i: F.coalesce(one(hashed, i), F.lit(0).cast("long"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def byte_size(text: Column) -> Column:
    """`12K`, `3.5M`, `1G` or plain digits as bytes; null where it is none of these."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[KMGkmg]?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"([KMGkmg])\s*$", 1))
    times = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    return F.when(number != "", F.expr("1.0D") * number.try_cast("double") * times)


def band_count(slots: int, threshold: float) -> int:
    """The number of bands, among the divisors of the slots, whose curve rises nearest to the threshold."""
    return min((b for b in range(1, slots + 1) if slots % b == 0), key=lambda b: abs((1 / b) ** (b / slots) - threshold))


def one_line(text: Column) -> Column:
    """Line ends and tabs as spaces."""
    return F.translate(text, "\n\t", "  ")


def clean_id(text: Column, drop: list[str]) -> Column:
    """An id without the given words, and with `--` as `-`."""
    for word in drop:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.replace(text, F.lit("--"), F.lit("-"))
