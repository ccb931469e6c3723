"""Strict and relaxed precision, recall and F1, and their statistics over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import dedup_spans, greedy_matches


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _report(counts: DataFrame) -> DataFrame:
    """Per label, micro and macro rows from (label, tp, n_pred, n_gold)."""
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gold"))
    per = counts.select("label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    per = per.withColumn("f1", f1)
    total = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"))
    micro = total.select(F.lit("micro").alias("label"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")).withColumn("f1", f1)
    macro = total.select(F.lit("macro").alias("label"), "tp", "fp", "fn", F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"))
    return per.unionByName(micro).unionByName(macro)


def strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Equal filename, label, start and end; labels of either side count. Repeated spans count once."""
    key = ["filename", "label", "start", "end"]
    one = dedup_spans(gold).select(*key, F.lit(1).alias("g"), F.lit(0).alias("p"))
    two = dedup_spans(pred).select(*key, F.lit(0).alias("g"), F.lit(1).alias("p"))
    both = one.unionByName(two).groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return _report(both.groupBy("label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold")))


def relaxed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlapping or touching spans match one to one, in row order; only labels of the gold side count."""
    g, p = dedup_spans(gold), dedup_spans(pred)
    tp = greedy_matches(g, p).groupBy("label").agg(F.sum("tp").alias("tp"))
    n = g.groupBy("label").agg(F.count(F.lit(1)).alias("n_gold")).join(p.groupBy("label").agg(F.count(F.lit(1)).alias("n_pred")), "label", "left")
    counts = n.join(tp, "label", "left").select("label", F.coalesce("tp", F.lit(0)).cast("long").alias("tp"), F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"), "n_gold")
    return _report(counts)


def fold_statistics(reports: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median, population and sample deviation (0 for one fold) of each metric over the folds."""
    long = reports.unpivot(by, metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std_pop"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_samp"), F.count("value").alias("n")
    )


def class_weights(counts: DataFrame, base: str, cap: float = 50.0) -> DataFrame:
    """total / (classes * count), over that of the base class, at most `cap`."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("label") == base, F.col("n"))).alias("base"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.least(F.lit(cap), F.col("base") / F.col("n")).alias("weight"))  # one row


def balanced_weights(counts: DataFrame) -> DataFrame:
    """total / (classes * count) by class, from (label, n)."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def multilabel_statistics(tokens: DataFrame, tags: str = "tags") -> DataFrame:
    """One row: tokens, those with a label, those with several; shares in percent, 0 where there is nothing to share."""
    n = F.size(tags)
    out = tokens.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(n > 0).alias("labelled"), F.count_if(n > 1).alias("multi"))
    return out.withColumn("percent_labelled", ratio(F.col("labelled") * 100.0, F.col("tokens"))).withColumn("percent_multi", ratio(F.col("multi") * 100.0, F.col("labelled")))


def label_balance(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, n_true, n_predicted) over the labels of either side."""
    both = true.select("label", F.lit(1).alias("t")).unionByName(predicted.select("label", F.lit(0).alias("t")))
    return both.groupBy("label").agg(F.sum("t").alias("n_true"), F.sum(1 - F.col("t")).alias("n_predicted"))


def probability_scores(rows: DataFrame, threshold: float = 0.5, empty: float = 0.0) -> DataFrame:
    """Precision, recall, F1 and area under the curve of (label, truth 0 or 1, prob): by label, over all rows (micro), and the labels' mean (macro).

    A probability over the threshold predicts 1; `empty` stands for a division by nothing; the area of rows that are all 0 or all 1 is null.
    Rows that lack a label, truth or probability are left out. Rows are counted by label and probability before they are ranked.
    """
    counts = rows.dropna(subset=["label", "truth", "prob"]).groupBy("label", "prob").agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    one = counts.select(F.lit("label").alias("scope"), "label", "prob", "pos", "neg")
    pooled = counts.groupBy("prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(F.lit("micro").alias("scope"), F.lit("").alias("label"), "prob", "pos", "neg")
    below = Window.partitionBy("scope", "label").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    ranked = one.unionByName(pooled).withColumn("wins", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2))
    over = F.col("prob") > threshold
    n = ranked.groupBy("scope", "label").agg(
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("wins")
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(empty)
    per = n.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("n_pos"))})
    both = F.col("precision") + F.col("recall")
    per = per.withColumns({"f1": part(2 * F.col("precision") * F.col("recall"), both), "auc": F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg")))})
    per = per.select("scope", "label", "precision", "recall", "f1", "auc")
    macro = per.where("scope = 'label'").groupBy(F.lit("macro").alias("scope"), F.lit("").alias("label")).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "auc")])
    return per.unionByName(macro)
