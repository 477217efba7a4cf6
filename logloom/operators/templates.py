"""Template mining: fixed-depth grouping trees that are grown by blocks and merged, and templates by strategy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import event_template, fold_space, mask_tokens
from logloom.operators.scan import key_blocks, own_rows
from logloom.sources.tables import stored

WILD = "<*>"
SPAN, FAN, MOST_CLUSTERS = 4096, 8, 8192
_LEAF = "__len int, __h string, __d int, __b bigint, __from bigint, __leaf bigint, template string"


def masked_message(message: Column) -> Column:
    """The message with variable parts as tokens, and <*> for each token that holds a digit; null is ''."""
    tokens = F.split(fold_space(mask_tokens(F.coalesce(message.cast("string"), F.lit("")))), " ")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t)), " ")


def grow(texts: list[list[str]], similarity: float) -> tuple[np.ndarray, list[list[str]]]:
    """Cluster token lists of one length in their order: a list joins the cluster with which it agrees in most tokens (the first of equal ones) if
    these are at least `similarity` of all, and the tokens in which they differ become <*>. Gives each list's cluster and the templates."""
    code = {WILD: 0}
    rows = np.array([[code.setdefault(w, len(code)) for w in t] for t in texts], np.int32)
    clusters, n, of = np.empty((16, rows.shape[1]), np.int32), 0, np.empty(len(rows), np.int64)
    for i, row in enumerate(rows):
        same = (clusters[:n] == row).sum(axis=1)
        at = int(same.argmax()) if n else -1
        if n and same[at] >= similarity * len(row):
            clusters[at, clusters[at] != row] = 0
        else:
            if n == len(clusters):
                clusters = np.concatenate([clusters, np.empty_like(clusters)])
            clusters[n], at, n = row, n, n + 1
        of[i] = at
    names = list(code)
    return of, [[names[c] for c in cluster] for cluster in clusters[:n].tolist()]


def _grown(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Grow the clusters of one block from rows (__len, __h, __d, __b, __from, template): __from is the first line of a text or of a cluster of before,
    __leaf that of the cluster that it joins."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("__from").combine_chunks()
        of, templates = grow([t.split(" ") for t in block["template"].to_pylist()], similarity)
        first = block["__from"].to_numpy()
        leaf = first[np.unique(of, return_index=True)[1]][of]
        made = [block[c] for c in ("__len", "__h", "__d", "__b", "__from")] + [pa.array(leaf), pa.array([" ".join(templates[k]) for k in of])]
        return pa.table(made, names=["__len", "__h", "__d", "__b", "__from", "__leaf", "template"])

    return run


def mine_templates(df: DataFrame, message: str, order: str, similarity: float = 0.5, lead: int = 2, span: int = SPAN, fan: int = FAN, most: int = MOST_CLUSTERS) -> DataFrame:
    """Add template and cluster_id (the cluster's first line) to each row, by a grouping tree over masked messages in first-seen order.

    Messages of equal length and equal first `lead` tokens are a node of the tree. A node's distinct messages are grown in blocks of about `span`
    of them in the order in which they are first seen (`order`: an integer line number), and the clusters of `fan` blocks are merged as messages
    are, in the order of their first lines, until each node is one block. A node of up to `span` distinct messages is thereby grown as one
    sequence. A node that has over `most` clusters while several blocks are left goes on at its children by the next token, so that no task
    holds more than some `fan` times `most` clusters. Null messages are empty ones.
    """
    rows = df.withColumn("__text", masked_message(F.col(message)))
    seen = stored(rows.groupBy("__text").agg(F.min(order).cast("bigint").alias("__from")).withColumn("__len", F.size(F.split("__text", " "))).withColumn("__h", F.concat_ws(" ", F.slice(F.split("__text", " "), 1, lead))))
    dealt = own_rows(key_blocks(seen, ["__len", "__h"], "__from", span=span)[0].withColumn("__block", F.col("__b").cast("bigint"))).withColumnRenamed("__block", "__b")
    node = ["__len", "__h", "__d", "__b"]
    texts = stored(dealt.select("__len", "__h", F.lit(lead).alias("__d"), "__b", "__from", F.col("__text").alias("template")).groupBy(*node).applyInArrow(_grown(similarity), _LEAF))
    clusters, chain = texts.filter("__from = __leaf"), None
    while True:
        whole = clusters.groupBy("__len", "__h", "__d").agg(F.max("__b").alias("last"), F.count("*").alias("c")).filter("last > 0")
        if whole.isEmpty():
            break
        open_ = clusters.join(whole, ["__len", "__h", "__d"])  # nodes of one block are done
        child = F.concat_ws(" ", "__h", F.element_at(F.split("template", " "), F.least(F.col("__d") + 1, F.col("__len"))))
        deeper = (F.col("c") > most) & (F.col("__d") < F.col("__len"))
        open_ = open_.withColumn("__h", F.when(deeper, child).otherwise(F.col("__h"))).withColumn("__d", F.col("__d") + F.when(deeper, 1).otherwise(0))
        merged = open_.select("__len", "__h", "__d", F.floor(F.col("__b") / fan).alias("__b"), F.col("__leaf").alias("__from"), "template")
        merged = stored(merged.groupBy(*node).applyInArrow(_grown(similarity), _LEAF))
        step = merged.select(F.col("__from").alias("__at"), F.col("__leaf").alias("__to"), F.col("template").alias("__merged"))
        if chain is None:
            chain = step
        else:
            after = chain.join(step.withColumnsRenamed({"__at": "__x", "__to": "__y", "__merged": "__z"}), F.col("__to") == F.col("__x"), "left")
            chain = after.select("__at", F.coalesce("__y", "__to").alias("__to"), F.coalesce("__z", "__merged").alias("__merged"))
        clusters = merged.filter("__from = __leaf")
    of = texts.select("__from", F.col("__leaf").alias("cluster_id"), "template")
    if chain is not None:
        of = of.join(chain, F.col("cluster_id") == F.col("__at"), "left").select("__from", F.coalesce("__to", "cluster_id").alias("cluster_id"), F.coalesce("__merged", "template").alias("template"))
    found = seen.select("__text", "__from").join(of, "__from").drop("__from")
    return rows.drop("template", "cluster_id").join(found, "__text").drop("__text")


def with_templates(df: DataFrame, strategy: str, order: str, provider: str = "provider", event_id: str = "event_id", channel: str | None = None, task: str | None = None, level: str | None = None, message: str = "raw_line") -> DataFrame:
    """Add template and cluster_id by strategy: provider_eventid, windows_evtx_canonical, windows_evtx_metadata (the template names its cluster),
    or drain, which mines the messages and takes the number of the cluster's first line."""
    if strategy == "drain":
        return mine_templates(df, message, order).withColumn("cluster_id", F.col("cluster_id").cast("string"))
    given = [F.col(c) if c else None for c in (channel, task, level)]
    made = event_template(strategy, F.col(provider), F.col(event_id), *given)
    return df.withColumn("template", made).withColumn("cluster_id", made)


def template_table(df: DataFrame) -> DataFrame:
    """(cluster_id, template, size) of rows with templates."""
    return df.groupBy("cluster_id", "template").agg(F.count("*").alias("size"))
