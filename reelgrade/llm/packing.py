"""Token ids packed into rows of one length: best-fit decreasing, with a segment tree over free capacities."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import claim, distinct, mix
from .tokencount import BATCH_CHARS, RESET, PieceCutter, character_classes

#: Tokens of a packed row; tokens that a task gathers before it packs them.
LENGTH, GATHER = 2048, 1 << 22
MEMORY_PIECES = 300_000


class TokenIds:
    """Ids of byte-level BPE; equal pieces of a batch are encoded once."""

    def __init__(self, ranks_path: str, pattern: str, classes: bytes):
        import zlib

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cutter = PieceCutter(np.frombuffer(zlib.decompress(classes), np.uint8))
        self.known: dict[str, bytes] = {}
        self.salt = mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(9))
        with np.errstate(over="ignore"):
            base, n = 0x9E3779B97F4A7C15 | 1, 3 * BATCH_CHARS
            p, q = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            self.power, self.back = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), np.uint32).tobytes()
        if len(piece) < 64:
            if len(self.known) > MEMORY_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Long texts are encoded alone, others up to BATCH_CHARS together."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > BATCH_CHARS:
                out += self._batch(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        return out + self._batch(group) if group else out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join([*texts, ""])
        if len(joined) >= len(self.power):  # one huge text: the library itself, in one go
            return [np.array(self.encoding.encode_ordinary(t), np.uint32) for t in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self.cutter.classes[points]
        kinds[ends] = RESET
        start = self.cutter.cuts(kinds)
        start[ends] = True
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(points))
        with np.errstate(over="ignore"):
            acc = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(self.salt[points] * self.power[: len(points)], out=acc[1:])
            hashed = (acc[stop] - acc[at]) * self.back[at]
        mark = np.zeros(len(at), bool)  # the marks between texts are pieces of their own, without tokens
        mark[np.searchsorted(at, ends)] = True
        hashed[mark] = 0
        first, back = distinct(points, at, stop, hashed)
        found, known = [], self.known
        for none, a, b in zip(mark[first].tolist(), at[first].tolist(), stop[first].tolist(), strict=True):
            piece = joined[a:b]
            found.append(b"" if none else known.get(piece) or self._piece(piece))
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        begin = np.cumsum(sizes) - sizes
        sizes, begin = sizes[back], begin[back]
        total = np.cumsum(sizes)
        where = np.repeat(begin - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        edges = total[np.searchsorted(at, ends)]
        return np.split(flat[where], edges[:-1])


@lru_cache(maxsize=2)
def token_ids(ranks_path: str, pattern: str, classes: bytes) -> TokenIds:
    return TokenIds(ranks_path, pattern, classes)


class CapacityTree:
    """A segment tree over free capacities 0 to n: which smallest capacity of at least some size do open bins have?"""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i //= 2

    def take(self, least: int) -> tuple[int, int]:
        """The bin with the smallest capacity >= least and that capacity; (-1, 0) if there is none."""
        i = least + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up, until something stands to the right
                i //= 2
            if i <= 1:
                return -1, 0
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.any[i] = 0
            i //= 2
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i //= 2
        return bin_, capacity


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces in each bin. Longest first (equal ones in order), each into the fullest bin that has room."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, free = tree.take(lengths[i])
        if bin_ < 0:
            bin_, free = len(bins), capacity
            bins.append([])
        bins[bin_].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], bin_)
    return bins


_SCHEMA = (
    "row_id long, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, first: int) -> pa.RecordBatch:
    rows: dict[str, list] = {n: [] for n in ("row_id", "n_tokens", "doc_ids", "parts", "cu_seqlens", "input_ids", "position_ids")}
    for k, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        own = [pieces[i] for i in members]
        edges = np.cumsum([0, *(len(p[2]) for p in own)])
        ids = np.full(length, pad, "<u4")
        places = np.zeros(length, "<u4")
        ids[: edges[-1]] = np.concatenate([p[2] for p in own])
        places[: edges[-1]] = np.arange(edges[-1]) - np.repeat(edges[:-1], np.diff(edges))
        for name, value in zip(
            rows, (first + k, int(edges[-1]), [p[0] for p in own], [p[1] for p in own], edges.tolist(), ids.tobytes(), places.astype("<u2" if length <= 65536 else "<u4").tobytes()), strict=True
        ):
            rows[name].append(value)
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=[*rows])


def pack_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, pad: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``length`` tokens: an id matrix with what is needed to take it apart again.

    row_id; n_tokens (the rest is padding); of the row's segments the doc_ids, parts (the how-manieth ``length`` tokens
    of the document, from 0) and cu_seqlens (cumulative lengths, from 0); input_ids (``length`` little-endian 32-bit
    ids) and position_ids (16-bit, or 32-bit for rows of over 65,536 tokens; they start again at 0 with each segment).

    A document of more than ``length`` tokens is split into parts, so that nothing is lost: the parts of a document in
    order are its ids. Each task packs what it reads, GATHER tokens at a time: nothing is shuffled, and memory does not
    grow with the partition. Null and empty texts have no tokens and no segment. Null and repeated ids are kept as they
    are (equal documents are packed each). Other columns are not read. No tokens: no rows.
    """
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = token_ids(ranks_path, pattern, classes)
        claim("ids", made.known.clear)
        held: list[tuple[int | None, int, np.ndarray]] = []
        size, first = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), made.encode(texts), strict=True):
                    for k in range(0, len(ids), length):
                        held.append((doc, k // length, ids[k : k + length]))
                        size += len(held[-1][2])
                        if size >= GATHER:
                            out = _packed(held, length, pad, first)
                            first += out.num_rows
                            held, size = [], 0
                            yield from (out.slice(j, 512) for j in range(0, out.num_rows, 512))
        if held:
            out = _packed(held, length, pad, first)
            yield from (out.slice(j, 512) for j in range(0, out.num_rows, 512))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The rows as Parquet, in the order of the tasks that made them."""
    packed.write.parquet(path)


def op3_token_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
