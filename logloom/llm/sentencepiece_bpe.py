"""SentencePiece merge-type encoding by backtracking, and decoding.

Chunks (a run of space marks and the word after it) are encoded once for a batch and kept in a bounded cache; no piece of the vocabulary spans the
border of two chunks (checked when the model is loaded), so chunks are independent.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from logloom.llm.common import read, with_columns

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Recent:
    """A bounded map in two generations: when the younger is full it becomes the older, so that what is asked often stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


@dataclass
class Codec:
    """The vocabulary of one model file: pieces with scores, single-character and byte pieces, and the automaton over mergeable pieces."""

    score: dict[str, float]
    number: dict[str, int]
    piece: list[str]
    byte_of: dict[int, int]
    byte_id: list[int]
    max_cached: int = 150_000

    def __post_init__(self):
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece spans the border of two words")
        self.chars = {p for p in self.score if len(p) == 1}
        if any(c not in self.chars for p in self.score for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        self.cache, self.pairs = Recent(self.max_cached), Recent(100_000)
        self.digits = pa.array(map(str, range(len(self.piece))), pa.large_string())
        self.surfaces = pa.array([p.replace(MARK, " ") for p in self.piece], pa.large_string())
        self.is_byte = np.isin(np.arange(len(self.piece)), list(self.byte_of))
        self.halves: dict[str, tuple[str, str]] = {}
        own = [p for p in self.score if self.merge(p, self.halves) == [p]]
        self.trie = ahocorasick.Automaton()
        for p in own:
            self.trie.add_word(p, p)
        self.trie.make_automaton()
        known = set(own)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in own}
        # a piece is made of pieces that merge before it; where scores say otherwise, or tie with another piece's, pairs are merged in full
        alike = Counter(self.score[p] for p in own if len(p) > 1)
        rank = {p: self.score[p] if len(p) > 1 else math.inf for p in own}
        odd = {p for p in own if len(p) > 1 and (alike[self.score[p]] > 1 or any(rank[h] <= rank[p] for h in self.halves[p]))}
        for p in sorted(own, key=len):
            if len(p) > 1 and odd.intersection(self.halves[p]):
                odd.add(p)
        self.odd, self.rank = odd, rank

    def merge(self, text: str, halves: dict | None = None) -> list[str]:
        """Merge the adjacent pair of best score, leftmost first, until no pair makes a piece; halves gets what a text that is one piece was last merged from."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        score, queue = self.score, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(part):
                s = score.get(part[i] + part[j])
                if s is not None:
                    heapq.heappush(queue, (-s, i, j, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if part[i] != a or part[j] != b or right[i] != j:
                continue
            part[i], part[j] = a + b, None
            if halves is not None and part[i] == text:
                halves[text] = a, b
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Merging the two pieces' text anew gives the same two pieces.

        The merges are undone from the last one back. At each step the two parts that touch may not make a piece that would have been
        merged before the step's own merge; of equal scores (one piece on both sides) the left one is merged first.
        """
        if a in self.odd or b in self.odd:
            return self.merge(a + b) == [a, b]
        score, rank, halves = self.score, self.rank, self.halves
        if a + b in score:
            return False
        left, right = rank[a], rank[b]
        while True:
            if left < right:
                limit, a = left, halves[a][1]
                left = rank[a]
                s = score.get(a + b)
                if s is not None and s > limit:
                    return False
            elif right < math.inf:
                limit, b = right, halves[b][0]
                right = rank[b]
                s = score.get(a + b)
                if s is not None and s >= limit:
                    return False
            else:
                return True

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        longest: list[str | None] = [None] * len(text)
        for end, p in self.trie.iter(text):  # by end: of the matches that start at a place the last one is the longest
            longest[end - len(p) + 1] = p
        longest.append(None)
        failed = bytearray(len(text) + 1)
        out: list[str] = []
        young, shorter = self.pairs.young, self.shorter
        at, p, before = 0, longest[0], None
        while p is not None:
            end = at + len(p)
            fits = not failed[end]
            if fits and before is not None:
                fits = young.get((before, p))
                if fits is None:
                    fits = self.pairs.get((before, p))
                    if fits is None:
                        fits = self.compatible(before, p)
                        self.pairs.put((before, p), fits)
                    young = self.pairs.young
            if fits:
                out.append(p)
                at, before, p = end, p, longest[end]
                continue
            p = shorter[p]
            if p is None:
                failed[at] = 1
                p = out.pop()
                at -= len(p)
                before = out[-1] if out else None
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        number = self.number
        if self.chars.issuperset(chunk):
            return [number[p] for p in self.pieces(chunk)]
        out: list[int] = []
        known = ""
        for c in chunk:
            if c in self.chars:
                known += c
                continue
            if known:
                out += [number[p] for p in self.pieces(known)]
                known = ""
            out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return out + ([number[p] for p in self.pieces(known)] if known else [])

    def surface(self, ids: list[int]) -> str:
        """Text of the ids, spaces for marks; runs of byte pieces are read as UTF-8, what isn't is U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.piece[i].replace(MARK, " "))
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first mark."""
        words = text.split(" ")
        if MARK in text or "" in words:
            return [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        return words

    def known(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk without its first mark."""
        got = self.cache.get(chunk)
        if got is None:
            got = tuple(self.chunk_ids(MARK + chunk))
            if len(chunk) <= 64:
                self.cache.put(chunk, got)
        return got

    def encode(self, text: str | None) -> tuple[list[tuple[tuple[int, ...]]], int]:
        """The chunks' ids, each in a tuple of its own, and the number of ids."""
        made = [(self.known(c),) for c in self.chunks(text)] if text else []
        return made, sum([len(m[0]) for m in made])

    def split(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of all texts in their order, each different one once, and how many each text has."""
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  "))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.fill_null(pc.or_(odd, pc.equal(texts, "")), True)
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        other = [self.chunks(t) if t else [] for t in texts.filter(odd).to_pylist()]
        flat = pa.concat_arrays([pc.list_flatten(plain), pa.array(chain.from_iterable(other), texts.type)])
        odd = odd.to_numpy(zero_copy_only=False)
        size = np.empty(len(odd), np.int64)
        size[~odd], size[odd] = pc.list_value_length(plain).to_numpy(), list(map(len, other))
        if not odd.any():
            return flat.dictionary_encode(), size
        at = np.empty(len(size), np.int64)
        at[~odd], at[odd] = np.cumsum(size[~odd]) - size[~odd], size[~odd].sum() + np.cumsum(size[odd]) - size[odd]
        order = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return flat.dictionary_encode().take(pa.array(order)), size

    def encode_all(self, texts: pa.Array, outputs: tuple[str, ...]) -> dict[str, pa.Array]:
        """What outputs of encode() names, for all texts at once: each different chunk is looked up once, the rest is gathered by number."""
        chunks, size = self.split(texts)
        get, known, of = self.cache.young.get, self.known, []
        for c in chunks.dictionary.to_pylist():
            got = get(c)
            if got is None:
                got = known(c)
                get = self.cache.young.get
            of.append(got)
        length = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter(chain.from_iterable(of), np.int32, int(length.sum()))
        start = np.cumsum(length) - length
        chunk = chunks.indices.to_numpy()
        n = length[chunk]
        ids = flat[np.repeat(start[chunk] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.append(0, np.cumsum(size))
        ends_of_ids = np.append(0, np.cumsum(n))[ends]
        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        made = {}
        if "n_tokens" in outputs:
            made["n_tokens"] = pa.array(np.diff(ends_of_ids))
        if "ids" in outputs:
            made["ids"] = listed(ends_of_ids, pa.array(ids))
        if "ids_text" in outputs:
            made["ids_text"] = pc.binary_join(listed(ends_of_ids, self.digits.take(pa.array(ids))), pa.scalar(",", pa.large_string()))
        if "decoded" in outputs:
            surface = pc.binary_join(listed(np.append(start, len(flat)), self.surfaces.take(pa.array(flat))), pa.scalar("", pa.large_string()))
            raw = np.zeros(len(of), bool)
            raw[np.repeat(np.arange(len(of)), length)[self.is_byte[flat]]] = True
            if raw.any():
                surface = pc.replace_with_mask(surface, pa.array(raw), pa.array([self.surface(of[i]) for i in np.flatnonzero(raw)], surface.type))
            made["decoded"] = pc.utf8_slice_codeunits(pc.binary_join(listed(ends, surface.take(chunks.indices)), pa.scalar("", pa.large_string())), 1)
        return made


def codec_of(data: bytes) -> Codec:
    """Read a model of merge type with the identity normalizer and a dummy prefix; others are refused."""
    m = model_pb2.ModelProto()
    m.ParseFromString(data)
    n = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces and m.trainer_spec.byte_fallback):
        raise ValueError("only merge-type models with byte fallback, no normalization and a dummy prefix")
    score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
    number = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
    byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(m.pieces) if p.type == BYTE}
    byte_id = [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])]
    return Codec(score, number, [p.piece if p.type == NORMAL else "" for p in m.pieces], byte_of, byte_id)


load = lru_cache(maxsize=2)(codec_of)


class Model:
    """A model file's content as it is broadcast. Its codec is made where a task first asks for it, and belongs to the broadcast: a worker keeps it
    from task to task of one job, and drops it, caches and all, before it does other work."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def codec(self) -> Codec:
        return codec_of(self.data)


def encode(docs: DataFrame, model: bytes, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Add what outputs names: n_tokens (bigint), ids (array<int>), ids_text (the ids, comma-joined) and decoded (the text that the ids decode to).

    model is the model file's content. Null and empty texts have no ids and decode to ''. Texts of any length are taken whole.
    Repeated rows get the same result; extra columns pass, but for those of the outputs' names; an empty table stays empty.
    """
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "ids_text": "string", "decoded": "string"}
    shared = docs.sparkSession.sparkContext.broadcast(Model(model))

    def run(batch: pa.RecordBatch) -> list:
        made = shared.value.codec.encode_all(batch.column(batch.schema.get_field_index(text)), outputs)
        return [made[o] for o in outputs]

    return with_columns(docs, ", ".join(f"{o} {kinds[o]}" for o in outputs), run)


def model_bytes(path: str | None = None) -> bytes:
    """Content of the model file; by default the public tokenizers' piece_bpe_32k.model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    got = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes(), outputs=("n_tokens", "ids_text", "decoded"))
    return got.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
