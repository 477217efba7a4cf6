"""Queries over evaluation (A13 to A24, J05 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import evaluate as ops
from logloom.plans.detect_queries import MODEL_SQL, scored_windows
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LOG_SQL, SCORED_SQL

_COUNTS = "count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp"


def _z(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / CAST({b} AS DOUBLE) END"


_P, _R, _S = _z("tp", "(tp + fp)"), _z("tp", "(tp + fn)"), _z("tn", "(tn + fp)")
_MEASURES = f"round({_z('tp + tn', '(tp + tn + fp + fn)')}, 9) AS accuracy, round({_P}, 9) AS precision, round({_R}, 9) AS recall, round({_z('2 * tp', '(2 * tp + fp + fn)')}, 9) AS f1, round(({_R} + {_S}) / 2, 9) AS balanced_accuracy, round({_S}, 9) AS specificity, round({_z('fp', '(fp + tn)')}, 9) AS fpr, round({_z('fn', '(fn + tp)')}, 9) AS fnr, tp + fn AS positives, tn + fp AS negatives"


@query(f"WITH {SCORED_SQL} SELECT {_COUNTS} FROM scored")
def a13_confusion(spark, d):
    return ops.confusion(A.scored_rows(spark, d))


@query(f"WITH {SCORED_SQL}, c AS (SELECT {_COUNTS} FROM scored) SELECT tn, fp, fn, tp, {_MEASURES} FROM c")
def a14_metrics(spark, d):
    return ops.metrics(ops.confusion(A.scored_rows(spark, d)))


@query(f"""WITH {SCORED_SQL}, h AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM h WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(CAST(sum(pos * (N - fp) + pos * neg / 2.0) AS DOUBLE) / (max(P) * max(N)), 9) AS roc_auc, round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(P), 9) AS average_precision FROM r""")
def a15_ranking_measures(spark, d):
    return ops.ranking_measures(A.scored_rows(spark, d), "score", "y_true")


@query(f"""WITH {SCORED_SQL}, c AS (SELECT {_COUNTS} FROM scored), t AS (SELECT '0' AS class, {_z('tn', '(tn + fn)')} AS precision, {_z('tn', '(tn + fp)')} AS recall, {_z('2 * tn', '(2 * tn + fn + fp)')} AS f1, CAST(tn + fp AS DOUBLE) AS support FROM c UNION ALL SELECT '1', {_P}, {_R}, {_z('2 * tp', '(2 * tp + fp + fn)')}, CAST(tp + fn AS DOUBLE) FROM c),
u AS (SELECT * FROM t UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM t UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM t)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM u""")
def a16_class_report(spark, d):
    return ops.class_report(ops.confusion(A.scored_rows(spark, d)))


_SWEEP = f"{SCORED_SQL}, g AS (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS step), c AS (SELECT step, count(*) FILTER (y_true = 0 AND NOT f) AS tn, count(*) FILTER (y_true = 0 AND f) AS fp, count(*) FILTER (y_true = 1 AND NOT f) AS fn, count(*) FILTER (y_true = 1 AND f) AS tp FROM (SELECT step, y_true, floor(score * 100 + 1e-9) >= step AS f FROM scored, g) GROUP BY step)"


@query(f"WITH {_SWEEP} SELECT step, step / 100.0 AS threshold, tn, fp, fn, tp, {_MEASURES} FROM c")
def a17_threshold_sweep(spark, d):
    return ops.sweep(A.scored_rows(spark, d), "score", "y_true")


@query(f"WITH {_SWEEP}, m AS (SELECT step, step / 100.0 AS threshold, tp, fp, {_MEASURES} FROM c) SELECT step, f1, recall, precision FROM m ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1")
def a17_best_threshold(spark, d):
    return ops.best_threshold(ops.sweep(A.scored_rows(spark, d), "score", "y_true")).select("step", "f1", "recall", "precision")


_CALIBRATE = f"""{SCORED_SQL}, b AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS base FROM scored), h AS (SELECT score, sum(CASE WHEN base = 0 THEN y_true ELSE 0 END) AS pos, sum(CASE WHEN base = 0 THEN 1 - y_true ELSE 0 END) AS neg FROM b GROUP BY score),
k AS (SELECT sum(base * y_true) AS p, sum(base * (1 - y_true)) AS n, sum(y_true) AS pp, sum(1 - y_true) AS nn FROM b),
c AS (SELECT score AS threshold, CAST(nn - (sum(neg) OVER w + n) AS BIGINT) AS tn, CAST(sum(neg) OVER w + n AS BIGINT) AS fp, CAST(pp - (sum(pos) OVER w + p) AS BIGINT) AS fn, CAST(sum(pos) OVER w + p AS BIGINT) AS tp FROM h, k WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT threshold, tn, fp, fn, tp, {_MEASURES} FROM c), e AS (SELECT *, recall >= 0.8 AS is_eligible, precision >= 0.2 AND fpr <= 0.5 AND abs(precision - recall) <= 0.7 AS passes_health FROM m)"""


def _calibrated(spark, d):
    rows = A.scored_rows(spark, d).withColumn("base", (F.col("doc_id") % 50 == 0).cast("int"))
    return ops.calibrate(rows, "score", "y_true", "base", 0.8, 0.2, 0.5, 0.7)


@query(f"WITH {_CALIBRATE} SELECT * FROM e")
def a18_calibration(spark, d):
    return _calibrated(spark, d)


@query(f"WITH {_CALIBRATE} SELECT threshold, f1, precision, recall, fp FROM e WHERE is_eligible ORDER BY passes_health DESC, f1 DESC, precision DESC, fp, threshold DESC LIMIT 1")
def a18_recommended_threshold(spark, d):
    return ops.recommended(_calibrated(spark, d)).select("threshold", "f1", "precision", "recall", "fp")


@query(f"WITH {_CALIBRATE} SELECT threshold, recall >= 0.8 AND f1 > 0.5347 AND precision >= 0.65 AND fpr <= 0.5 AND abs(precision - recall) <= 0.3 AS passed, concat_ws('|', CASE WHEN recall < 0.8 THEN 'recall' END, CASE WHEN f1 <= 0.5347 THEN 'f1_score' END, CASE WHEN precision < 0.65 THEN 'precision' END, CASE WHEN fpr > 0.5 THEN 'false_positive_rate' END, CASE WHEN abs(precision - recall) > 0.3 THEN 'precision_recall_gap' END) AS failed FROM e")
def a19_promotion_gate(spark, d):
    return ops.promotion_gate(_calibrated(spark, d)).select("threshold", "passed", F.array_join("failed_criteria", "|").alias("failed"))


@query(f"WITH {SCORED_SQL}, q AS (SELECT source, score, CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 1 THEN 'FP' WHEN y_true = 1 THEN 'FN' ELSE 'TN' END AS quadrant FROM scored JOIN documents USING (doc_id)), c AS (SELECT quadrant, source, count(*) AS n_rows FROM q GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY n_rows DESC, source) AS rank FROM c) SELECT * FROM r WHERE rank <= 10 AND quadrant IN ('FP', 'FN')")
def a20_error_analysis(spark, d):
    from logloom.operators.aggregates import top_values

    rows = A.scored_rows(spark, d).join(A.table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("quadrant", ops.quadrant())
    return top_values(rows.filter("quadrant IN ('FP', 'FN')"), ["quadrant"], "source", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {SCORED_SQL}, q AS (SELECT score, CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 1 THEN 'FP' WHEN y_true = 1 THEN 'FN' ELSE 'TN' END AS quadrant FROM scored) SELECT quadrant, count(*) AS n, round(avg(score), 9) AS mean_score FROM q GROUP BY quadrant")
def a20_quadrant_scores(spark, d):
    return A.scored_rows(spark, d).groupBy(ops.quadrant().alias("quadrant")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


@query(f"WITH {SCORED_SQL} SELECT CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN y_pred = 1 THEN 'low' ELSE 'none' END AS tier, y_true, count(*) AS n FROM scored GROUP BY ALL")
def a21_tier_by_truth(spark, d):
    tier = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.7, "medium").when(F.col("y_pred") == 1, "low").otherwise("none")
    return A.scored_rows(spark, d).groupBy(tier.alias("tier"), "y_true").agg(F.count("*").alias("n"))


@query(f"WITH {MODEL_SQL} SELECT host, bool_or(rank IS NULL OR rank > 9) AS y_pred, round(max(1 - p), 9) AS score, count(*) AS n_windows FROM scored GROUP BY host")
def a22_session_predictions(spark, d):
    return ops.session_predictions(scored_windows(spark, d), "host", F.col("rank").isNull() | (F.col("rank") > 9), "p")


@query(f"WITH {MODEL_SQL}, h AS (SELECT rank AS k, count(*) AS n FROM scored WHERE rank IS NOT NULL GROUP BY rank), r AS (SELECT k, sum(n) OVER (ORDER BY k) / (SELECT CAST(count(*) AS DOUBLE) FROM scored) AS share FROM h) SELECT min(k) AS k FROM r WHERE share >= 0.5")
def a23_smallest_k(spark, d):
    return ops.smallest_k(scored_windows(spark, d), "rank", 0.5).select(F.col("k").cast("bigint").alias("k"))


@query(f"WITH {MODEL_SQL} SELECT CAST(ceil(quantile_cont(rank, 0.0099)) AS BIGINT) AS k_as_fraction_of_100, CAST(ceil(quantile_cont(rank, 0.99)) AS BIGINT) AS k_99 FROM scored WHERE rank IS NOT NULL")
def a24_recommended_k(spark, d):
    rows = scored_windows(spark, d).filter("rank IS NOT NULL")
    return rows.agg(F.ceil(F.percentile("rank", F.lit(0.0099))).alias("k_as_fraction_of_100"), F.ceil(F.percentile("rank", F.lit(0.99))).alias("k_99"))


_ALIGN = f"""{LOG_SQL}, w AS (SELECT unnest(range(0, (SELECT (max(line_id) - 20) // 10 + 1 FROM log))) AS window_id), win AS (SELECT window_id, window_id * 10 + 1 AS start_idx, window_id * 10 + 20 AS end_idx, window_id * 10 + 20 AS target_row FROM w), lab AS (SELECT line_id AS row, y FROM log WHERE k % 3 = 0),
i AS (SELECT window_id, max(y) AS a, avg(y) AS m FROM win JOIN lab ON row BETWEEN start_idx AND end_idx GROUP BY window_id)"""


def _windows(spark, d):
    log = A.structured_log(spark, d)
    last = log.agg(F.max("line_id")).first()[0] or 0
    ids = spark.range(0, max(0, (last - 20) // 10 + 1)).withColumnRenamed("id", "window_id")
    start = F.col("window_id") * 10
    return ids.select("window_id", (start + 1).alias("start_idx"), (start + 20).alias("end_idx"), (start + 20).alias("target_row")), log.filter("k % 3 = 0").select(F.col("line_id").alias("row"), "y")


@query(f"WITH {_ALIGN} SELECT window_id, coalesce(lab.y, a) AS y_true, CASE WHEN lab.y IS NOT NULL THEN 'target_line' ELSE 'any' END AS label_source FROM win LEFT JOIN lab ON row = target_row LEFT JOIN i USING (window_id) WHERE coalesce(lab.y, a) IS NOT NULL")
def j05_align_any(spark, d):
    return ops.align_windows(*_windows(spark, d)).select("window_id", "y_true", "label_source")


@query(f"WITH {_ALIGN} SELECT window_id, coalesce(lab.y, CAST(m >= 0.25 AS INTEGER)) AS y_true, CASE WHEN lab.y IS NOT NULL THEN 'target_line' ELSE 'ratio' END AS label_source FROM win LEFT JOIN lab ON row = target_row LEFT JOIN i USING (window_id) WHERE coalesce(lab.y, CAST(m >= 0.25 AS INTEGER)) IS NOT NULL")
def j05_align_ratio(spark, d):
    return ops.align_windows(*_windows(spark, d), policy="ratio", ratio=0.25).select("window_id", "y_true", "label_source")


