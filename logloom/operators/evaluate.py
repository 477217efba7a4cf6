"""Evaluation: metrics, ranking measures, sweeps, calibration, gates and alignment of windows with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.scan import running_sums


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", keys: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """tn, fp, fn, tp for each key, rows counted by weight."""
    one = F.lit(1) if weight is None else weight
    cell = lambda t, p: F.coalesce(F.sum(F.when((F.col(y_true) == t) & (F.col(y_pred) == p), one)), F.lit(0)).cast("bigint")
    return df.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(counts: DataFrame, digits: int = 9) -> DataFrame:
    """Measures of tn, fp, fn, tp; a division by zero gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fp)
    values = {"accuracy": _share(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": _share(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + specificity) / 2, "specificity": specificity, "fpr": _share(fp, fp + tn), "fnr": _share(fn, fn + tp)}
    return counts.select("*", *[F.round(v, digits).alias(k) for k, v in values.items()], (tp + fn).alias("positives"), (tn + fp).alias("negatives"))


def score_histogram(df: DataFrame, score: str, y_true: str, keys: tuple[str, ...] = (), base: str | None = None, weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score, of rows that no base decision flags already; rows count by weight."""
    rows = df if base is None else df.filter(F.col(base) == 0)
    one = F.lit(1) if weight is None else F.col(weight)
    return rows.groupBy(*keys, score).agg(F.sum(F.col(y_true) * one).cast("bigint").alias("pos"), F.sum((1 - F.col(y_true)) * one).cast("bigint").alias("neg"))


def ranking_measures(df: DataFrame, score: str, y_true: str, digits: int = 9, weight: str | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, from the histogram of scores; null where one class is missing or no score is there.

    The running sums over distinct scores are dealt by ranges of the score. Rows count by weight, as if each were there so often.
    """
    h = score_histogram(df.filter(F.col(score).isNotNull()), score, y_true, weight=weight)
    r, total = running_sums(h, [F.desc(score)], {"tp": "pos", "fp": "neg"})
    pos, neg = (F.lit(total[c]).cast("double") for c in ("tp", "fp"))
    area = F.sum(F.col("pos") * (neg - F.col("fp")) + F.col("pos") * F.col("neg") / 2)
    got = r.agg(area.alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    ok = (pos > 0) & (neg > 0)
    return got.select(F.round(F.when(ok, F.col("area") / (pos * neg)), digits).alias("roc_auc"), F.round(F.when(ok, F.col("ap") / pos), digits).alias("average_precision"))


def class_report(counts: DataFrame, digits: int = 9) -> DataFrame:
    """Precision, recall, F1 and support of both classes, and their plain and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    row = lambda name, t, p, n: F.struct(F.lit(name).alias("class"), _share(t, t + p).alias("precision"), _share(t, t + n).alias("recall"), _share(2 * t, 2 * t + p + n).alias("f1"), (t + n).cast("double").alias("support"))
    two = counts.select(F.explode(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))).alias("r")).select("r.*")
    names = ("precision", "recall", "f1")
    plain = two.agg(F.lit("macro").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = two.agg(F.lit("weighted").alias("class"), *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    out = two.unionByName(plain).unionByName(weighted)
    return out.select("class", *[F.round(n, digits).alias(n) for n in (*names, "support")])


def sweep(df: DataFrame, score: str, y_true: str, steps: int = 100, digits: int = 9, weight: str | None = None) -> DataFrame:
    """Counts and measures at each threshold 0, 1/steps ... 1 (flagged: score >= threshold; null scores never): each row falls into the bin of
    the highest threshold that it reaches, and bins are summed from above. Rows count by weight."""
    one = F.lit(1) if weight is None else F.col(weight)
    level = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int")
    bins = df.groupBy(F.coalesce(level, F.lit(-1)).alias("step")).agg(F.sum(F.col(y_true) * one).cast("bigint").alias("pos"), F.sum((1 - F.col(y_true)) * one).cast("bigint").alias("neg"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    r = grid.join(bins, "step", "left").fillna(0, ["pos", "neg"]).withColumn("tp", F.sum("pos").over(above)).withColumn("fp", F.sum("neg").over(above))
    r = r.withColumn("fn", F.sum("pos").over(W.partitionBy()) - F.col("tp")).withColumn("tn", F.sum("neg").over(W.partitionBy()) - F.col("fp")).filter("step >= 0")
    return metrics(r.select("step", (F.col("step") / steps).alias("threshold"), "tn", "fp", "fn", "tp"), digits)


def best_threshold(rows: DataFrame) -> DataFrame:
    """The row of best F1, then recall, then precision, then least threshold."""
    return rows.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def calibrate(df: DataFrame, score: str, y_true: str, base: str, target_recall: float = 0.8, min_precision: float = 0.0, max_fpr: float = 1.0, max_gap: float = 1.0, digits: int = 9, weight: str | None = None) -> DataFrame:
    """Measures at each distinct score as threshold (flagged: score >= threshold, or base), with is_eligible (recall) and passes_health.

    One shuffle to the histogram of distinct scores, then running sums over ranges of it. Rows count by weight.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    total = lambda v, flag=None: F.coalesce(F.sum((v if flag is None else F.when(F.col(base) == flag, v)) * one), F.lit(0))
    is_pos, is_neg = F.col(y_true), 1 - F.col(y_true)
    fixed = df.agg(total(is_pos, 1).alias("p"), total(is_neg, 1).alias("n"), total(is_pos).alias("P"), total(is_neg).alias("N")).first()
    h = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(score).agg(total(is_pos, 0).alias("pos"), total(is_neg, 0).alias("neg"))
    r, _ = running_sums(h, [F.desc(score)], {"__tp": "pos", "__fp": "neg"})
    tp, fp = F.col("__tp") + fixed["p"], F.col("__fp") + fixed["n"]
    rows = metrics(r.select(F.col(score).alias("threshold"), (F.lit(fixed["N"]) - fp).cast("bigint").alias("tn"), fp.cast("bigint").alias("fp"), (F.lit(fixed["P"]) - tp).cast("bigint").alias("fn"), tp.cast("bigint").alias("tp")), digits)
    healthy = (F.col("precision") >= min_precision) & (F.col("fpr") <= max_fpr) & (F.abs(F.col("precision") - F.col("recall")) <= max_gap)
    return rows.withColumn("is_eligible", F.col("recall") >= target_recall).withColumn("passes_health", healthy)


def recommended(rows: DataFrame, require_healthy: bool = False) -> DataFrame:
    """Of eligible rows (healthy ones if any) the best by F1, precision, fewest false positives, highest threshold. No such row is an error."""
    eligible = rows.filter("is_eligible")
    best = eligible.orderBy(F.desc("passes_health"), F.desc("f1"), F.desc("precision"), "fp", F.desc("threshold")).limit(1)
    found = best.select("passes_health").first()
    if found is None:
        raise ValueError("no threshold reaches the target recall")
    if require_healthy and not found[0]:
        raise ValueError("no healthy threshold reaches the target recall")
    return best


def promotion_gate(measures: DataFrame, baseline_f1: float = 0.5347, recall: float = 0.80, precision: float = 0.65, fpr: float = 0.50, gap: float = 0.30) -> DataFrame:
    """passed, and failed_criteria (array) of recall, f1, precision, fpr and the gap of precision and recall."""
    checks = {"recall": F.col("recall") >= recall, "f1_score": F.col("f1") > baseline_f1, "precision": F.col("precision") >= precision, "false_positive_rate": F.col("fpr") <= fpr, "precision_recall_gap": F.abs(F.col("precision") - F.col("recall")) <= gap}
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return measures.withColumn("failed_criteria", failed).withColumn("passed", F.size("failed_criteria") == 0)


def quadrant(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    t, p = F.col(y_true), F.col(y_pred)
    return F.when((t == 1) & (p == 1), "TP").when((t == 0) & (p == 1), "FP").when((t == 1) & (p == 0), "FN").otherwise("TN")


def align_windows(windows: DataFrame, labels: DataFrame, policy: str = "any", ratio: float = 0.5) -> DataFrame:
    """Truth of each window (window_id, start_idx, end_idx, target_row): the label of its target row if that has one, else any, majority or
    ratio of its rows' labels. Windows without any label are left out. labels: (row, y).

    Both sides of the join by row are shuffled: Spark takes unfolded windows for as few rows as there are windows, and would broadcast them.
    """
    share = {"any": F.max("y"), "majority": (F.avg("y") >= 0.5).cast("int"), "ratio": (F.avg("y") >= ratio).cast("int")}[policy]
    inside = windows.select("window_id", F.explode(F.sequence("start_idx", "end_idx")).alias("row")).join(labels.hint("merge"), "row").groupBy("window_id").agg(share.alias("by_rows"))
    exact = labels.select(F.col("row").alias("target_row"), F.col("y").alias("by_target"))
    out = windows.join(exact, "target_row", "left").join(inside, "window_id", "left").withColumn("y_true", F.coalesce("by_target", "by_rows"))
    return out.filter("y_true IS NOT NULL").withColumn("label_source", F.when(F.col("by_target").isNotNull(), "target_line").otherwise(policy)).drop("by_target", "by_rows")


def session_predictions(windows: DataFrame, session: str, miss: Column, p: str) -> DataFrame:
    """A session is flagged if any window misses; its score is the largest 1 - p."""
    return windows.groupBy(session).agg(F.bool_or(miss).alias("y_pred"), F.round(F.max(1 - F.col(p)), 9).alias("score"), F.count("*").alias("n_windows"))


def smallest_k(ranks: DataFrame, rank: str, accuracy: float = 0.997) -> DataFrame:
    """The least k of which the share of ranks up to k reaches the accuracy; null ranks are never reached."""
    every = ranks.count()
    h = ranks.filter(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("k")).agg(F.count("*").alias("n"))
    r, _ = running_sums(h, [F.col("k")], {"reached": "n"})
    return r.filter(F.col("reached") / F.lit(float(max(1, every))) >= accuracy).agg(F.min("k").alias("k"))
