"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read, with_columns

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FIND = re.compile(WORDS).findall


def words_of(text: str | None) -> list[str]:
    """Words of the text with A-Z in lower case; null has none."""
    if not text:
        return []
    return _FIND(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes: only A-Z change


class WuManber:
    """Patterns of one length, in words. The shift table tells, for the last block (two words) of the place looked at, how far
    the next possible occurrence is; where that is zero, the block's bucket holds the patterns that end so, and these are compared.
    """

    def __init__(self, length: int, patterns: dict[tuple[str, ...], list]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - 1] if self.block == 1 else (p[end - 2], p[end - 1])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[p[-1] if self.block == 1 else p[-2:]].append((list(p), items))

    def search(self, words: list[str], hit: list[tuple[int, int]], items: set) -> None:
        """Add each occurrence's span of words to hit and its items to items."""
        length, get, far, at, n = self.length, self.shift.get, self.far, self.length - 1, len(words)
        one = self.block == 1
        while at < n:
            key = words[at] if one else (words[at - 1], words[at])
            step = get(key, far)
            if step:
                at += step
                continue
            start = at - length + 1
            here = words[start : at + 1]
            for pattern, of in self.bucket[key]:
                if pattern == here:
                    hit.append((start, at + 1))
                    items.update(of)
            at += 1


def _windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct (words of a window, item) pairs of the benchmark, as one space-joined string each."""

    def run(batches):
        for batch in batches:
            out, ids = [], []
            for i, t in enumerate(batch.column(1)):
                w = words_of(t.as_py())
                made = {" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else ()
                out.extend(made)
                ids.extend([i] * len(made))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.string())], ["item_id", "words"])

    return benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "item_id string, words string").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_windows: int = 200_000) -> DataFrame:
    """Add n_words long, hit_spans (array of word spans, merged) and items (sorted array of strings) to every document.

    Item words in windows of `window` consecutive words; an item with fewer words is one window, one with none has none.
    The benchmark is the stated query set: while it has at most max_windows windows they go out as one broadcast; more are dealt by hash
    to blocks of about that many, and the documents are scanned once a block and stored between blocks, so that a task holds one block's
    tables; spans and items are merged, so nothing is lost.
    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows are each scanned; extra columns
    pass, but for those of the three names, which are replaced. A null item_id counts as the item ''.
    """
    spark = docs.sparkSession
    pairs = materialize(_windows(benchmark, item, item_text, window))
    blocks = max(1, -(-pairs.count() // max_windows))
    out = docs
    for b in range(blocks):
        by_length: dict[int, dict[tuple[str, ...], list]] = defaultdict(dict)
        for r in pairs.filter(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == b).collect():
            w = tuple(r["words"].split(" "))
            by_length[len(w)].setdefault(w, []).append(r["item_id"] or "")
        shared = spark.sparkContext.broadcast([WuManber(n, p) for n, p in sorted(by_length.items())])

        def run(batch: pa.RecordBatch, shared=shared, first=b == 0) -> list:
            before = {} if first else {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "items")}
            n_words, spans, found = [], [], []
            for k, t in enumerate(batch.column(batch.schema.get_field_index(text))):
                w, hit, items = words_of(t.as_py()), [], set()
                for m in shared.value:
                    m.search(w, hit, items)
                if not first:
                    hit.extend((x["start"], x["end"]) for x in before["hit_spans"][k])
                    items.update(before["items"][k])
                merged: list[list[int]] = []
                for s, e in sorted(hit):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                n_words.append(len(w))
                spans.append([{"start": s, "end": e} for s, e in merged])
                found.append(sorted(items))
            return [n_words, spans, found]

        out = with_columns(out, "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>", run) if b == 0 else _again(materialize(out), run)  # stored between blocks: one block's tables at a time
    return out


def _again(df: DataFrame, run) -> DataFrame:
    """A further block over the same documents; the columns so far are inputs too."""
    renamed = with_columns(df, "n_words2 bigint, hit_spans2 array<struct<start: bigint, end: bigint>>, items2 array<string>", run)
    for c in ("n_words", "hit_spans", "items"):
        renamed = renamed.drop(c).withColumnRenamed(f"{c}2", c)
    return renamed


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    got = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
