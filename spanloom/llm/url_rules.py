"""URL filters: fixed host and path rules first, association rules for the rest.

The urls that a fixed rule judges are the labels. Spark's FP-growth mines the token combinations of labelled urls together with
their verdict; rules with a verdict on the right side are pruned by confidence and support, and one that a shorter rule with the
same verdict and at least its confidence covers is dropped. An inverted index from tokens to rules then finds, for a url, the
rules whose tokens it has all; the most confident decides, and where none fits the default holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The production rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in reversed(ordered):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: scheme, host labels (the last one marked), path parts without numbers, names of arguments."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("?"), F.substring_index(x, "=", 1)))
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit("")))),
            F.array(F.concat(F.lit("end:"), F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")))),
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
            names,
        )
    )


def mine_rules(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, most_rules: int = 2_000, longest: int = 3) -> list[tuple[frozenset[str], str, float, float]]:
    """Association rules from (tokens, verdict) rows: antecedent, verdict, confidence, support; the best first.

    The rules that pass both limits come to the driver; more than `most_rules` of them are an error, as any cut could drop needed
    ones. Rules of over `longest` tokens are left out. No rows, no rules.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit(VERDICT)) & (F.size("antecedent") <= longest))
    rules = rules.withColumn("antecedent", F.sort_array("antecedent"))
    best = rules.orderBy(F.col("confidence").desc(), F.col("support").desc(), F.size("antecedent"), F.to_json("antecedent")).limit(most_rules + 1).collect()
    if len(best) > most_rules:
        raise ValueError(f"more than {most_rules} rules pass the limits: raise support, confidence or most_rules")
    kept: list[tuple[frozenset[str], str, float, float]] = []
    for r in sorted(best, key=lambda r: (len(r.antecedent), -r.confidence, -r.support, r.antecedent)):
        have, verdict = frozenset(r.antecedent), r.consequent[0].removeprefix(VERDICT)
        if not any(a <= have and v == verdict and c >= r.confidence for a, v, c, _ in kept):
            kept.append((have, verdict, r.confidence, r.support))
    return sorted(kept, key=lambda r: (-r[2], -r[3], sorted(r[0])))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", **limits) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined_rule.

    `rule` is the fixed rule that decides (null if none fits), `mined_rule` the association rule that does (null if it isn't
    needed or none fits). Null urls and urls without `://` have an empty host and path and are judged by their tokens like
    others. Repeated rows give repeated results; an empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(rows.where("fit IS NOT NULL").select("tokens", F.col("fit.verdict").alias("verdict")), **limits)
    index: dict[str, list[int]] = defaultdict(list)
    for n, (tokens, *_) in enumerate(mined):
        for token in tokens:
            index[token].append(n)
    shared = pages.sparkSession.sparkContext.broadcast((dict(index), [(len(r[0]), r[1], " & ".join(sorted(r[0]))) for r in mined]))  # bounded by most_rules

    @F.pandas_udf("struct<verdict:string,mined_rule:string>")
    def by_index(tokens: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        where, known = shared.value
        for part in tokens:
            out = []
            for own in part:
                hits: dict[int, int] = defaultdict(int)
                for token in own:
                    for n in where.get(token, ()):
                        hits[n] += 1
                full = min((n for n, k in hits.items() if k == known[n][0]), default=None)
                out.append((default, None) if full is None else (known[full][1], known[full][2]))
            yield pd.DataFrame(out, columns=["verdict", "mined_rule"])

    rows = rows.withColumn("method", by_index("tokens"))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "method.verdict").alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("method.mined_rule")).alias("mined_rule"),
    )
