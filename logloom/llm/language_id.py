"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import bounded_sample, held_out, read, with_columns

UNDETERMINED = "und"
MAX_MODEL_BYTES = 64 << 20
_SLICE = 1 << 20


def ngram_buckets(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of each character n-gram of the lower-cased text, in slices that overlap by the longest order."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    longest, out = max(orders), []
    for at in range(0, max(1, len(codes) - longest + 1), _SLICE):
        part = codes[at : at + _SLICE + longest - 1]
        for n in orders:
            count = len(part) - n + 1
            if at + _SLICE < len(codes) - longest + 1:
                count = _SLICE
            if count <= 0:
                continue
            h = np.full(count, n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + part[k : k + count]
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class LanguageModel:
    """Log-probabilities of each bucket (rows) in each language (columns), and the languages' log priors."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def score_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; und and 0 where the text is null or has no letter, or nothing was learned.

        The texts' n-grams are counted as sparse rows (text, bucket, count), many texts at once, and multiplied with the matrix.
        """
        total = np.tile(self.log_prior, (len(texts), 1))
        known = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            row = np.repeat([i for i, _ in held], [len(x) for _, x in held]).astype(np.uint64)
            cell, n = np.unique(row << np.uint64(self.bits) | np.concatenate([x for _, x in held]), return_counts=True)
            of = (cell >> np.uint64(self.bits)).astype(np.int64)
            at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            weighed = n[:, None] * self.log_prob[(cell & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
            total[of[at]] += np.add.reduceat(weighed, at, axis=0)

        for i, t in enumerate(texts):
            if not known[i]:
                continue
            buckets = ngram_buckets(t, self.orders, self.bits)
            for at in range(0, len(buckets), _SLICE):
                held.append((i, buckets[at : at + _SLICE]))
                size += len(held[-1][1])
                if size >= _SLICE:
                    add()
                    held, size = [], 0
        if held:
            add()
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = np.argmax(total, axis=1)
        posterior = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0)

    def score(self, text: str | None) -> tuple[str, float]:
        """Of one text."""
        language, posterior = self.score_all([text])
        return language[0], float(posterior[0])


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", orders: tuple[int, ...] = (2, 3), bits: int = 16, max_train: int = 20_000, alpha: float = 0.5) -> LanguageModel:
    """Count n-grams by language over a bounded sample of the labelled rows (about max_train, chosen by a hash of the key).

    Rows with a null text or label teach nothing. No labelled rows: a model that always answers und.
    What reaches the driver is one number for each language and bucket; bits shrinks until the matrix is under MAX_MODEL_BYTES.
    """
    rows = bounded_sample(docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")), F.col("k"), max_train, 10)
    names = sorted(r["l"] for r in rows.select("l").distinct().collect())
    while len(names) * 4 << bits > MAX_MODEL_BYTES and bits > 10:
        bits -= 1
    number = {n: i for i, n in enumerate(names)}

    def count(batches):
        counts = np.zeros((len(names), 1 << bits), np.int64)
        documents = np.zeros(len(names), np.int64)
        for batch in batches:
            for t, language in zip(batch.column(0), batch.column(1), strict=True):
                i = number[language.as_py()]
                counts[i] += np.bincount(ngram_buckets(t.as_py(), orders, bits), minlength=1 << bits)
                documents[i] += 1
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(lang, np.arange(len(names))), pa.int32()), pa.array(np.append(bucket, np.full(len(names), -1)), pa.int32()), pa.array(np.append(counts[lang, bucket], documents), pa.int64())], ["lang", "bucket", "n"])

    counts, documents = np.full((1 << bits, len(names)), alpha), np.full(len(names), 1.0)
    if names:
        got = rows.select("t", "l").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        grams = got[got.bucket >= 0]
        counts[grams.bucket, grams.lang] += grams.n
        documents[got[got.bucket < 0].lang] += got[got.bucket < 0].n
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(documents / documents.sum()), orders, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred (string) and score (double, 0 to 1) to every row; the whole text counts.

    Null and letterless texts (no str.isalpha character): und, 0. Repeated rows get the same answer; extra columns pass, but for those of the
    two names, which are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        return list(shared.value.score_all(batch.column(batch.schema.get_field_index(text)).to_pylist()))

    return with_columns(docs, "lang_pred string, score double", run)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
