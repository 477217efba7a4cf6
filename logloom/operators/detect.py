"""The count-based next-event model, window decisions and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.parse import event_identity, important_fields, line_summary
from logloom.operators.similarity import token_containment

SEPARATOR = "\x1f"


def _suffixes(history: Column, order: int) -> Column:
    """array<struct<order, suffix>> of the last 0 to `order` events, as far as the history goes."""
    have = F.least(F.size(history), F.lit(order))
    return F.transform(F.sequence(F.lit(0), have), lambda o: F.struct(o.alias("order"), F.array_join(F.slice(history, F.size(history) - o + 1, o), SEPARATOR).alias("suffix")))


def fit_next_event(samples: DataFrame, order: int, topk: int = 9, history: str = "history", target: str = "target") -> DataFrame:
    """Back-off counts: (order, suffix, event, n, total, rank, topk). Ranks go by count, then event; topk lists a suffix's first events.

    Counts are summed before the shuffle; a suffix's ranked group is at most the vocabulary.
    """
    rows = samples.select(F.explode(_suffixes(F.col(history), order)).alias("s"), F.col(target).alias("event")).select("s.order", "s.suffix", "event")
    counts = rows.groupBy("order", "suffix", "event").agg(F.count("*").alias("n"))
    of = W.partitionBy("order", "suffix")
    ranked = counts.withColumn("total", F.sum("n").over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "event")))
    return ranked.withColumn("topk", F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= topk, F.struct("rank", "event"))).over(of)), lambda x: x["event"]))


def score_next_event(windows: DataFrame, model: DataFrame, order: int, history: str = "history", target: str = "target") -> DataFrame:
    """Add order_used, p (0 if the target was never seen there), rank (null likewise) and topk from the longest suffix that the model knows.

    Equal (history, target) pairs are scored once and joined back.
    """
    last = F.slice(F.col(history), F.greatest(F.size(history) - order + 1, F.lit(1)), order)
    asked = windows.select(F.array_join(last, SEPARATOR).alias("__h"), last.alias("__last"), F.col(target).alias("__t")).dropDuplicates(["__h", "__t"])
    keys = asked.select("__h", "__t", F.explode(_suffixes(F.col("__last"), order)).alias("s")).select("__h", "__t", "s.order", "s.suffix")
    known = model.filter("rank = 1").select("order", "suffix", "topk")
    best = keys.join(known, ["order", "suffix"]).groupBy("__h", "__t").agg(F.max(F.struct("order", "suffix", "topk")).alias("b")).select("__h", "__t", "b.*")
    hit = best.join(model.select("order", "suffix", F.col("event").alias("__t"), "n", "total", "rank"), ["order", "suffix", "__t"], "left")
    scored = hit.select("__h", "__t", F.col("order").alias("order_used"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("p"), "rank", "topk")
    return windows.withColumn("__h", F.array_join(last, SEPARATOR)).withColumn("__t", F.col(target)).join(scored, ["__h", "__t"], "left").drop("__h", "__t")


def event_ids(df: DataFrame, vocabulary: DataFrame, event: str, unknown: str = "<UNK>", similar: bool = False) -> DataFrame:
    """event_idx of each row's event; for events outside the vocabulary that of the known event whose tokens they hold most of (with similar), else
    the unknown token's. Each distinct unseen event is looked up once."""
    known = vocabulary.select(F.col("event").alias(event), "event_idx")
    n = vocabulary.filter(F.col("event") == unknown).select("event_idx").first()
    if similar:
        unseen = df.select(event).distinct().join(known, event, "left_anti").withColumn("__key", F.xxhash64(event).cast("bigint"))
        named = vocabulary.filter(F.col("event") != unknown).select(F.col("event_idx").cast("bigint").alias("__key"), F.col("event").alias(event))
        best = token_containment(unseen, named, "__key", event)
        known = known.unionByName(unseen.join(best, "__key").select(event, F.col("match").cast(known.schema["event_idx"].dataType).alias("event_idx")))
    return df.join(known, event, "left").withColumn("event_idx", F.coalesce("event_idx", F.lit(n[0] if n else None)))


def unknown_share(history: Column, target: Column, is_known) -> tuple[Column, Column]:
    """Unknown events among history and target, and their share."""
    n = F.size(F.filter(history, lambda e: ~is_known(e))) + F.when(is_known(target), 0).otherwise(1)
    return n, n / (F.size(history) + 1)


MODES = ("ignore", "warn", "anomaly", "evaluate")


def decide(df: DataFrame, topk: int, mode: str = "warn", max_unknown_ratio: float = 0.5, boost_from: float = 0.75) -> DataFrame:
    """Window decisions from p, rank, unknown_target, unknown_ratio and heuristic_score.

    Adds evaluation_status, is_anomaly, strict_is_anomaly and anomaly_score. A heuristic score from boost_from on makes an unknown window an
    anomaly; else the mode says what unknown windows are; all others are anomalies if the target is not among the first topk.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    reason = F.when(F.col("unknown_target"), "unknown_template").when(F.col("unknown_ratio") >= max_unknown_ratio, "unknown_template_ratio_exceeded")
    unknown = reason.isNotNull() & F.lit(mode != "evaluate")
    boosted = unknown & (F.col("heuristic_score") >= boost_from)
    miss = F.col("rank").isNull() | (F.col("rank") > topk)
    status = F.when(boosted, "evtx_heuristic_boost").when(unknown, F.when(F.lit(mode == "ignore"), "skipped_unknown").otherwise(reason)).when(miss, "deeplog_topk_miss").otherwise("evaluated")
    anomaly = F.when(boosted, True).when(unknown, F.lit(mode == "anomaly")).otherwise(miss)
    score = F.when(boosted, F.col("heuristic_score")).when(unknown, F.lit(1.0 if mode == "anomaly" else 0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("p")))
    return df.withColumn("evaluation_status", status).withColumn("is_anomaly", anomaly).withColumn("strict_is_anomaly", ~unknown & miss).withColumn("anomaly_score", score)


def apply_policy(df: DataFrame, policy: str = "topk", threshold: float | None = None) -> DataFrame:
    """topk leaves decisions as they are; f1_constrained_recall adds evaluated windows whose score reaches the threshold, and removes none."""
    policy = {"strict": "topk", "topk_miss": "topk", "deeplog_topk": "topk"}.get((policy or "topk").strip().lower(), (policy or "topk").strip().lower())
    if policy not in ("topk", "f1_constrained_recall"):
        raise ValueError("policy must be topk or f1_constrained_recall")
    if policy == "topk" or threshold is None:
        return df
    more = ~F.col("is_anomaly") & ~F.col("strict_is_anomaly") & (F.col("evaluation_status") == "evaluated") & (F.col("anomaly_score") >= threshold)
    rows = df.withColumn("__more", more)
    return rows.withColumn("evaluation_status", F.when(F.col("__more"), "score_threshold_exceeded").otherwise(F.col("evaluation_status"))).withColumn("is_anomaly", F.col("is_anomaly") | F.col("__more")).drop("__more")


HIGH_STATUSES = ("deeplog_topk_miss", "unknown_template", "unknown_template_ratio_exceeded", "evtx_heuristic_boost", "evtx_sparse_fallback")


def candidate_tier(df: DataFrame, medium_from: float = 0.70) -> DataFrame:
    """candidate_tier (none, low, medium, high) and candidate_reasons (array)."""
    status = F.col("evaluation_status")
    tier = F.when(~F.col("is_anomaly"), "none").when(F.col("strict_is_anomaly") | status.isin(*HIGH_STATUSES), "high").when(F.col("anomaly_score") >= medium_from, "medium").otherwise("low")
    own = F.array(F.when(F.col("strict_is_anomaly"), "topk_miss"), F.when(status == "score_threshold_exceeded", "score_threshold"), F.when(status.startswith("unknown_template"), status), F.when(status.isin("evtx_heuristic_boost", "evtx_sparse_fallback"), status))
    reasons = F.array_distinct(F.filter(own, lambda r: r.isNotNull()))
    return df.withColumn("candidate_tier", tier).withColumn("candidate_reasons", F.when(F.col("is_anomaly"), reasons).otherwise(F.array().cast("array<string>")))


def window_payload(windows: DataFrame, lines: DataFrame, line: str, template: str, parameters: str) -> DataFrame:
    """(window_id, lines): the lines of each window (window_id, start_row, target_row, is_anomaly; bounds included) in order, as structs of line number,
    template, parameters, important fields, the event's provider and id, the line's summary, and whether it is the target of an anomaly.

    Windows are unfolded to line numbers and joined; a window's list is as long as the window.
    """
    fields = important_fields(F.col(parameters))
    provider, event_id = event_identity(F.col(template))
    told = lines.select(F.col(line).alias("line_number"), F.col(template).alias("event_template"), F.col(parameters).alias("parameters"), fields.alias("important_fields"), provider.alias("provider"), event_id.alias("event_id"))
    told = told.withColumn("line_summary", line_summary(F.col("event_template"), F.col("important_fields")))
    held = windows.select("window_id", "target_row", "is_anomaly", F.explode(F.sequence(F.col("start_row").cast("bigint"), F.col("target_row").cast("bigint"))).alias("line_number")).join(told, "line_number")
    one = F.struct("line_number", "event_template", "parameters", "important_fields", "provider", "event_id", "line_summary", (F.col("is_anomaly") & (F.col("line_number") == F.col("target_row"))).alias("is_anomalous_line"))
    return held.groupBy("window_id").agg(F.collect_list(one).alias("lines")).withColumn("lines", F.array_sort("lines", lambda a, b: (a["line_number"] - b["line_number"]).cast("int")))


def count_model(rows: DataFrame, history: str, also: list[str], label: str, bits: int = 16, penalty: float = 0.01, rounds: int = 100):
    """Logistic regression on columns and on how often each event is in the history: every event counts, in one of 2^bits places by its hash, so that
    no vocabulary is gathered. Nulls of columns are 0. Gives the function that adds score, the probability of label 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def features(df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in also})
        counted = HashingTF(inputCol=history, outputCol="__counts", numFeatures=1 << bits).transform(filled)
        return VectorAssembler(inputCols=[f"__{c}" for c in also] + ["__counts"], outputCol="__features").transform(counted)

    known = features(rows.filter(F.col(label).isNotNull())).withColumn("__label", F.col(label).cast("double"))
    model = LogisticRegression(maxIter=rounds, regParam=penalty, tol=1e-9, featuresCol="__features", labelCol="__label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction").fit(known)
    made = [f"__{c}" for c in also] + ["__counts", "__features", "__raw", "__probability", "__prediction"]
    return lambda df: model.transform(features(df)).withColumn("score", vector_to_array("__probability")[1]).drop(*made)


def cross_scored(rows: DataFrame, history: str, also: list[str], label: str, fold: str, **options) -> DataFrame:
    """Every row of folds 0 and 1 with the score of the model of the other fold."""
    out = [count_model(rows.filter(F.col(fold) != i), history, also, label, **options)(rows.filter(F.col(fold) == i)) for i in (0, 1)]
    return out[0].unionByName(out[1])


def topk_flags(df: DataFrame, ks: list[int], topk: str = "topk", target: str = "target") -> DataFrame:
    """One row for each k: whether the target is among the first k of a list that was scored once."""
    at = F.array_position(topk, F.col(target))
    return df.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("is_miss", ~at.between(1, F.col("k")))


#: Terms and their weights, as the scoring rule has them.
SUSPICIOUS_TERMS = {
    "encodedcommand": 0.45, " -enc ": 0.45, "invoke-mimikatz": 0.5, "mimikatz": 0.5, "lsass": 0.35, "sekurlsa": 0.5, "rundll32": 0.3, "regsvr32": 0.35,
    "certutil": 0.35, "wmic": 0.25, "powershell": 0.3, "downloadstring": 0.45, "frombase64string": 0.45, "schtasks": 0.25, "\\temp\\": 0.2,
}
#: Event ids, levels and command tokens of the same rule.
SUSPICIOUS_IDS = ("1", "3", "7", "8", "10", "11", "13", "22", "4698", "7045")
SUSPICIOUS_LEVELS = ("critical", "error", "warning", "warn")
SUSPICIOUS_COMMANDS = ("-enc", "encodedcommand", "downloadstring", "frombase64string")


def suspicion(text: Column, event_id: Column, level: Column, command: Column, target_object: Column) -> tuple[Column, Column]:
    """Score (at most 1) and reasons of a sparse event row."""
    has = lambda c, t: F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
    terms = [(has(text, t), w, F.lit(f"term:{t.strip()}")) for t, w in SUSPICIOUS_TERMS.items()]
    any_command = F.lit(False)
    for t in SUSPICIOUS_COMMANDS:
        any_command = any_command | has(command, t)
    level = F.lower(level)
    rules = [*terms, (event_id.isin(*SUSPICIOUS_IDS), 0.2, F.concat(F.lit("event_id:"), event_id)), (level.isin(*SUSPICIOUS_LEVELS), 0.1, F.concat(F.lit("level:"), level)), (any_command, 0.25, F.lit("field:command_line")), (has(target_object, "\\temp\\"), 0.1, F.lit("field:target_object"))]
    score = sum((F.when(c, w).otherwise(0.0) for c, w, _ in rules), F.lit(0.0))
    return F.least(F.lit(1.0), score), F.filter(F.array(*[F.when(c, r) for c, _, r in rules]), lambda r: r.isNotNull())


def short_file_fallback(df: DataFrame, file: str, window: int, score: Column, least: float = 0.75) -> DataFrame:
    """Rows of files of at most `window` rows whose own score reaches `least`."""
    return df.withColumn("__n", F.count("*").over(W.partitionBy(file))).withColumn("fallback_score", score).filter((F.col("__n") <= window) & (F.col("fallback_score") >= least)).drop("__n")


def triage(windows: DataFrame, verdicts: DataFrame, case: str, key: list[str], score: str, review: int = 20) -> DataFrame:
    """The `review` anomalies of best score of each case get the verdict of a label table (uncertain without one); noise goes, the rest stays
    with the verdict not_reviewed."""
    ranked = windows.withColumn("review_rank", F.row_number().over(W.partitionBy(case).orderBy(F.desc(score), *key)))
    joined = ranked.join(verdicts.select(*key, F.col("verdict").alias("__v")), key, "left")
    out = joined.withColumn("verdict", F.when(F.col("review_rank") <= review, F.coalesce("__v", F.lit("uncertain"))).otherwise("not_reviewed")).drop("__v")
    return out.filter("verdict <> 'noise'")


def file_profile(df: DataFrame, file: str, line: str, text: Column, order: str, first: int = 200) -> DataFrame:
    """(file, n_lines, sysmon_share, n_linux, profile): sysmon if half of all lines or more name it; linux if, of the first lines, at least
    min(5, n) and 30 % look like Linux; else default."""
    rows = df.withColumn("__i", F.row_number().over(W.partitionBy(file).orderBy(order)))
    linux = text.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}\s|^type=")
    got = rows.groupBy(file).agg(F.count("*").alias("n_lines"), F.round(F.avg(F.contains(F.lower(line), F.lit("sysmon")).cast("double")), 6).alias("sysmon_share"), F.count_if((F.col("__i") <= first) & linux).alias("n_linux"), F.count_if(F.col("__i") <= first).alias("__first"))
    enough = (F.col("n_linux") >= F.least(F.lit(5), F.col("n_lines"))) & (F.col("n_linux") >= F.col("__first") * 0.3)
    return got.withColumn("profile", F.when(F.col("sysmon_share") >= 0.5, "sysmon").when(enough, "linux").otherwise("default")).drop("__first")


def board_lane(flagged: Column, retained: Column, score: Column) -> tuple[Column, Column]:
    """Lane and priority of a line."""
    lane = F.when(~flagged, "normal").when(retained, "investigate").otherwise("review")
    return lane, F.when(~flagged, "none").when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")
