"""Aggregations: catalogues, profiles, roll-ups, vocabularies, deduplication and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.scan import key_blocks, own_rows
from logloom.operators.windows import number_rows
from logloom.sources.tables import stored


def template_catalogue(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each template (or cluster and template); nulls are a group of their own."""
    return df.groupBy(*keys).agg(F.count("*").alias("size"))


def top_values(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group of keys, ties by value: (keys, value, n_rows, rank)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n_rows"))
    w = W.partitionBy(*keys).orderBy(F.desc("n_rows"), value)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def profile(df: DataFrame, template: str, event_id: str, time: str, label: str) -> DataFrame:
    """One row: rows, distinct templates and ids, first and last time, labelled rows and their share."""
    attacks = F.count_if(F.col(label) != "-")
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(template).alias("n_templates"), F.countDistinct(event_id).alias("n_ids"), F.min(time).alias("first_t"), F.max(time).alias("last_t"), attacks.alias("n_attacks"), F.round(100.0 * attacks / F.count("*"), 6).alias("attack_percent"))


def fixed_status_counts(df: DataFrame, keys: list[str], status: str, names: list[str]) -> DataFrame:
    """A count for each named status, zeros kept."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == n).alias(f"n_{n}") for n in names])


def sequence_stats(sessions: DataFrame, sequence: str, label: str, least: int) -> DataFrame:
    """Number of sessions, of those of at least `least` events, of normal ones, and the shortest, longest and mean length of the kept ones."""
    kept = sessions.withColumn("__n", F.size(sequence)).filter(F.col("__n") >= least)
    return kept.agg(F.count("*").alias("n_kept"), F.count_if(F.col(label) == 0).alias("n_normal"), F.min("__n").alias("shortest"), F.max("__n").alias("longest"), F.round(F.avg("__n"), 6).alias("mean_length"))


def vocabulary(sessions: DataFrame, sequence: str, order: str, padding: str = "padding", unknown: str = "<UNK>") -> DataFrame:
    """(event, event_idx): padding is 0, events follow in the order in which they are first seen, the unknown token is last."""
    seen = sessions.select(order, F.posexplode(sequence).alias("pos", "event")).groupBy("event").agg(F.min(F.struct(order, "pos")).alias("first"))
    ids = number_rows(seen.select("event", F.col("first")[order].alias("o"), F.col("first")["pos"].alias("p")), "o", "p", name="event_idx").select("event", "event_idx")
    n = ids.count()
    ends = ids.sparkSession.createDataFrame([(padding, 0), (unknown, n + 1)], "event string, event_idx bigint")
    return ids.unionByName(ends)


def count_vectors(samples: DataFrame, keys: list[str], history: str) -> DataFrame:
    """Sparse counts of the events of a history: (keys, event, n)."""
    return samples.select(*keys, F.explode(history).alias("event")).groupBy(*keys, "event").agg(F.count("*").alias("n"))


def collapse_sequences(df: DataFrame, sequence: str, order: str, label: str, by_label: bool) -> DataFrame:
    """Equal sequences become one row: first row, weight (share of all rows), least label; with by_label, labels are kept apart."""
    total = df.count()
    keys = [sequence, label] if by_label else [sequence]
    aggs = [F.min(order).alias("first_row"), (F.count("*") / F.lit(float(max(1, total)))).alias("weight")]
    return df.groupBy(*keys).agg(*aggs, *([] if by_label else [F.min(label).alias(label)]))


def normal_once_normal_always(df: DataFrame, sequence: str, label: str) -> DataFrame:
    """A sequence that is labelled normal once is normal everywhere."""
    return df.withColumn(label, F.min(label).over(W.partitionBy(sequence)))


def dedupe_sessions(df: DataFrame, sequence: str, order: str, label: str) -> DataFrame:
    """Equal sequences become one row: the last label, how often, and the first row."""
    return df.groupBy(sequence).agg(F.max_by(label, order).alias(label), F.count("*").alias("n"), F.min(order).alias("first_row"))


def expand_by_count(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def rounded(value: Column, digits: int) -> Column:
    """The double nearest to the value with so many digits, by its exact binary value (ties to even)."""
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")


def ema_fold(
    df: DataFrame, keys: list[str], order: str, success: str, latency: str, rate: float = 0.05, latency_rate: float = 0.1, digits: int = 3, latency_digits: int = 2,
    start: float = 0.5, latency_start: float = 1.0, tail: int = 4096, chunk: int = 65_536,
) -> DataFrame:
    """(keys, n_calls, n_success, success_rate, success_ema, latency_ema): moving means of success and latency in call order, rounded at each step,
    and totals. A null success is a failure, a null latency leaves its mean as it is.

    A step never changes the order of two means, so that a fold of a key's last `tail` calls from the lowest and from the highest mean that its
    values allow bounds the fold of all calls: where both end alike, that is the result, and no other call is looked at. (Rounding makes means of
    unlike starts meet soon.) Keys for which they don't are folded from their first call on, `chunk` calls at a time with the means carried. So no
    more than a chunk of a key's calls is ever one list.
    """
    one = lambda: F.coalesce(F.col(success).cast("double"), F.lit(0.0))
    calls = df.select(*keys, F.col(order).alias("o"), one().alias("s"), F.col(latency).cast("double").alias("l"))
    step = lambda old, new, r, d: F.coalesce(rounded(old * (1 - r) + new * r, d), old)
    fold = lambda s, l: F.aggregate("calls", F.struct(s.alias("s"), l.alias("l")), lambda a, c: F.struct(step(a["s"], c["s"], rate, digits).alias("s"), step(a["l"], c["l"], latency_rate, latency_digits).alias("l")))  # noqa: E731, E741
    listed = lambda rows, *also: rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("o", "s", "l"))).alias("calls"), *also)
    same = lambda a, b: F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys))

    totals = stored(calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.sum("s").cast("bigint").alias("n_success"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("l").alias("l0"), F.max("l").alias("l1")))
    last = calls.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("o"), F.desc("s"), F.desc("l")))).filter(F.col("n") <= tail).drop("n")
    whole = F.col("n_calls") <= tail
    low = lambda c, first, d: F.when(whole, first).otherwise(F.least(F.col(c), F.lit(first)) - 10.0**-d)
    high = lambda c, first, d: F.when(whole, first).otherwise(F.greatest(F.col(c), F.lit(first)) + 10.0**-d)
    rows = listed(last).alias("a").join(totals.alias("b"), same("a", "b")).select("b.*", "calls")
    rows = rows.withColumn("x", fold(low("s0", start, digits), low("l0", latency_start, latency_digits))).withColumn("y", fold(high("s1", start, digits), high("l1", latency_start, latency_digits)))
    ends = stored(rows.select(*keys, "n_calls", "n_success", "x", (F.col("x") == F.col("y")).alias("is_known")))
    result = [ends.filter("is_known").select(*keys, "n_calls", "n_success", F.col("x.s").alias("success_ema"), F.col("x.l").alias("latency_ema"))]
    unknown = ends.filter("NOT is_known")
    most = unknown.agg(F.max("n_calls")).first()[0]
    if most:
        dealt, _ = key_blocks(calls.alias("a").join(unknown.select(*keys).alias("b"), same("a", "b"), "left_semi"), keys, "o")
        parts = stored(own_rows(dealt.withColumn("part", F.floor(F.col("__i") / chunk))))
        state = unknown.select(*keys, F.lit(start).alias("ms"), F.lit(latency_start).alias("ml"))
        for part in range(-(-most // chunk)):
            now = listed(parts.filter(F.col("part") == part))
            joined = state.alias("b").join(now.alias("a"), same("a", "b"), "left").select("b.*", F.coalesce("calls", F.array().cast(now.schema["calls"].dataType)).alias("calls"))
            state = stored(joined.select(*keys, fold(F.col("ms"), F.col("ml")).alias("m")).select(*keys, F.col("m.s").alias("ms"), F.col("m.l").alias("ml")))
        result.append(unknown.alias("a").join(state.alias("b"), same("a", "b")).select("a.*", F.col("ms").alias("success_ema"), F.col("ml").alias("latency_ema")).drop("x", "is_known"))
    got = result[0] if len(result) == 1 else result[0].unionByName(result[1])
    return got.select(*keys, "n_calls", "n_success", rounded(F.col("n_success") / F.col("n_calls"), 3).alias("success_rate"), "success_ema", "latency_ema")


def most_frequent(df: DataFrame, keys: list[str], value: str, measure: str) -> DataFrame:
    """For each key the most frequent value (ties by value), its count, and the mean of measure over all rows."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(measure).alias("total"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("best"), F.sum("n").alias("n_all"), F.sum("total").alias("total")).select(*keys, F.col("best")[value].alias(value), F.col("best.n").alias("n"), F.round(F.col("total") / F.col("n_all"), 6).alias("mean_measure"))


def first_distinct(df: DataFrame, keys: list[str], value: str, order: str, n: int) -> DataFrame:
    """The first n distinct values of each key in the order in which they are first seen: (keys, value, rank)."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("__o"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("__o", value))).filter(F.col("rank") <= n).drop("__o")


def word_idf(docs: DataFrame, document: str, words: str, word: str = "word", only: DataFrame | None = None) -> DataFrame:
    """(word, idf): natural log of documents over documents that hold the word; of rows with a list of words, or of those that `only` (word) names.

    A row's list is made distinct, so that rows of a document id that comes once are counted where they are and only counts are shuffled; rows of
    an id that comes again are counted by distinct pairs. A null id is no document; words of such rows alone have an infinite idf.
    """
    ids = stored(docs.filter(F.size(words) > 0).groupBy(F.col(document).alias("__d")).agg(F.count("*").alias("__n")))
    n, most = ids.agg(F.count("__d"), F.coalesce(F.max(F.when(F.col("__d").isNotNull(), F.col("__n"))), F.lit(1))).first()
    held = lambda rows: rows.select(F.col(document).alias("__d"), F.explode(F.array_distinct(words)).alias(word))
    cut = lambda rows: rows if only is None else rows.join(only, word, "left_semi")
    once = docs
    if most > 1:
        again = ids.filter((F.col("__n") > 1) & F.col("__d").isNotNull()).select("__d")
        same = F.col(document) == F.col("__d")
        once = docs.join(again, same, "left_anti")
    counts = cut(held(once)).groupBy(word).agg(F.count("__d").alias("df"))
    if most > 1:
        more = cut(held(docs.join(again, same, "left_semi"))).groupBy(word).agg(F.countDistinct("__d").alias("df"))
        counts = counts.unionByName(more).groupBy(word).agg(F.sum("df").alias("df"))
    return counts.select(word, F.round(F.when(F.col("df") > 0, F.log(F.try_divide(F.lit(float(n)), F.col("df")))).otherwise(float("inf") if n else float("nan")), 9).alias("idf"))


def weighted_vectors(words: DataFrame, vectors: DataFrame, keys: list[str], word: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, dim, value): mean of the words' vectors, or their sum weighted by weight (a column of words). Words without a vector count as none."""
    rows = words.withColumn("__w", F.lit(1.0) if weight is None else weight).join(vectors, word).select(*keys, "__w", F.posexplode(vector).alias("dim", "x"))
    value = F.avg("x") if weight is None else F.sum(F.col("x") * F.col("__w"))
    return rows.groupBy(*keys, "dim").agg(F.round(value, 6).alias("value"))


def score_summary(df: DataFrame, sets: list[list[str]], score: str, passed: str) -> DataFrame:
    """Mean, population deviation, pass rate and range for each grouping set; keys that a set leaves out are null."""
    names = sorted({k for s in sets for k in s})
    return df.groupingSets([tuple(F.col(k) for k in s) for s in sets], *names).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("deviation"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("pass_rate"), F.min(score).alias("least"), F.max(score).alias("most"))


def lines_to_templates(mapping: DataFrame, template: str = "event_template", lines: str = "line_ids") -> DataFrame:
    """(line_id, template) of rows (template, line ids), of which a template may have many."""
    return mapping.select(F.explode(lines).alias("line_id"), template)
