"""Exact token counts of a byte-level BPE tokenizer by finite-state transducers.

Two transducers are compiled from the tokenizer's file. The first reads character classes and cuts a text into the
pieces of the pre-tokenizer's pattern. Its eleven states make a chunk of text a small map from states to states: all
chunks of a batch are mapped side by side, the maps are composed by a parallel prefix scan, and a second pass from the
entry states found gives the cuts. The second reads the bytes of a piece; each transition carries the number of tokens
that it emits (it may be negative, as a later byte can merge what stood apart), so that a path's sum is the piece's
token count. Its states are made when first reached.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import claim, distinct, mix

# Classes of characters, as the pattern tells them apart.
LETTER, STMD, R, V, LL, E, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, RESET = range(12)
# States: what the current piece is so far.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_APOSTROPHE, AT_RV, AT_L, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(11)
STATES = 11
# What a transition emits: a cut before this character, one before the last, or the last cut taken back.
CUT, CUT_LAST, UNCUT_LAST = 1, 2, 4

CHUNK = 64
#: Characters of a batch of documents; a longer document is a batch of its own, in parts of this size.
BATCH_CHARS = 1 << 20
#: Pieces whose counts a worker remembers, and states it keeps, before it starts anew.
MEMORY_PIECES, MEMORY_STATES = 400_000, 150_000


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """The transition and emission tables [class, state] of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    to, out = np.zeros((12, STATES), np.uint8), np.zeros((12, STATES), np.uint8)
    home = {**dict.fromkeys((LETTER, STMD, R, V, LL, E), IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}
    for c in range(RESET):
        for s in range(STATES):
            spaces = s >= ONE_SPACE
            if c in (SPACE, WHITE):
                new = (MORE_SPACE if spaces else ONE_SPACE) + (c == WHITE)
                to[c, s], out[c, s] = new, 0 if spaces else CUT
                continue
            kind = home[c]
            run = IN_LETTERS if s in (AT_RV, AT_L) else IN_OTHERS if s == AT_APOSTROPHE else s
            if s == AT_APOSTROPHE and c == STMD:
                to[c, s], out[c, s] = FRESH, 0
            elif (s == AT_RV and c == E) or (s == AT_L and c == LL):
                to[c, s], out[c, s] = FRESH, UNCUT_LAST
            elif s == AT_APOSTROPHE and c in (R, V, LL):
                to[c, s], out[c, s] = (AT_L if c == LL else AT_RV), CUT
            elif s in (ONE_SPACE, MORE_SPACE):  # the space before belongs to this piece
                to[c, s], out[c, s] = kind, CUT_LAST if s == MORE_SPACE else 0
            else:
                cut = 0 if run == kind else CUT
                if s == MORE_WHITE:
                    cut |= CUT_LAST
                to[c, s], out[c, s] = (AT_APOSTROPHE if c == APOSTROPHE and cut else kind), cut
    return to, out


@lru_cache(maxsize=1)
def character_classes() -> bytes:
    """The class of every code point, packed. It is asked of the library itself (its Unicode tables may differ from
    Python's), once, on the driver; the workers get some kilobytes."""
    from tokenizers import pre_tokenizers

    ask = pre_tokenizers.ByteLevel(add_prefix_space=False)
    found = np.full(0x110000, OTHER, np.uint8)
    points = [p for p in [*range(1, 0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= p < 0xE000]
    for mark, kind in (("a", LETTER), ("1", NUMBER)):  # after a letter, only a letter stays in its piece
        for block in (points[i : i + 20_000] for i in range(0, len(points), 20_000)):
            for _, (a, b) in ask.pre_tokenize_str("".join(f"{mark}{chr(p)}\0" for p in block)):
                if a % 3 == 0 and b == a + 2:
                    found[block[a // 3]] = kind
    for block in (points[i : i + 20_000] for i in range(0, len(points), 20_000)):  # white space leaves the \0 after it
        for _, (a, b) in ask.pre_tokenize_str("".join(f"!{chr(p)}\0" for p in block)):
            if a % 3 == 1 and b == a + 1 and found[block[a // 3]] == OTHER:
                found[block[a // 3]] = WHITE
    found[ord(" ")] = SPACE
    for text, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E), ("'", APOSTROPHE)):
        for c in text:
            found[ord(c)] = kind
    return zlib.compress(found.tobytes())


class PieceCutter:
    """Cuts a batch of texts into the pre-tokenizer's pieces."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        to, out = _cutter()
        self.to, self.out = to.ravel(), out.ravel()  # by class * STATES + state

    def cuts(self, kinds: np.ndarray) -> np.ndarray:
        """Where pieces start, for an array of classes; RESET ends all context."""
        n = len(kinds)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, RESET, np.int16)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T) * np.int16(STATES)
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)  # [start state, chunk]
        for row in grid:
            maps = self.to[row[None, :] + maps]
        state = self._entries(maps)
        out = np.empty((CHUNK, rows), np.uint8)
        for i, row in enumerate(grid):
            at = row + state
            out[i] = self.out[at]
            state = self.to[at]
        flags = np.ascontiguousarray(out.T).ravel()[:n]
        start = (flags & CUT) != 0
        last = np.flatnonzero(flags & CUT_LAST)
        start[last - 1] = True
        start[np.flatnonzero(flags & UNCUT_LAST) - 1] = False
        return start

    @staticmethod
    def _entries(maps: np.ndarray) -> np.ndarray:
        """The state before each chunk: an inclusive scan of the chunks' maps, each step composing maps twice as long."""
        scan, step, rows = maps.copy(), 1, maps.shape[1]
        where = np.arange(rows)
        while step < rows:
            scan[:, step:] = scan[scan[:, :-step], where[None, step:]]
            step *= 2
        entry = np.full(rows, FRESH, np.uint8)
        entry[1:] = scan[FRESH, :-1]
        return entry


class MergeTransducer:
    """Counts the BPE tokens of a byte string along a path of states.

    After a prefix, a BPE encoding's last token is unique, and what precedes that token is the encoding of the shorter
    prefix. A later token can begin only where the rest is a prefix of some token; the state holds, for those
    positions, the last token before them and the count there against the count here. Two tokens may stand side by
    side if no merge across their border would come before the merges that made their edges.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *(a + b for a, b in merges)])}
        if missing := set(vocabulary) - set(self.ids):
            raise ValueError(f"tokens that no merge makes: {sorted(missing)[:3]}")
        self.rank = {}
        n = 256
        parts: list[tuple[int, int] | None] = [None] * 256
        for a, b in merges:
            pair = (self.ids[a], self.ids[b])
            if self.ids[a + b] != n:
                raise ValueError("two merges make the same token")
            self.rank[pair] = n
            parts.append(pair)
            n += 1
        never = n + 1
        self.right, self.left = [], []  # edges of a token, each with the merge that ends its time as an edge
        for t in range(n):
            r, end, spine = t, never, []
            while True:
                spine.append((r, end))
                if parts[r] is None:
                    break
                end, r = r, parts[r][1]
            self.right.append(spine)
            l, end, spine = t, never, []  # noqa: E741
            while True:
                spine.append((l, end))
                if parts[l] is None:
                    break
                end, l = l, parts[l][0]  # noqa: E741
            self.left.append(spine)
        self.prefixes = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.keys: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.step: list[dict[int, tuple[int, int]]] = []
        self._state((b"", (-1,), (0,)))

    def _state(self, key: tuple) -> int:
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        return found

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            rank, found = self.rank, True
            for x, until_x in self.right[a]:
                for y, until_y in self.left[b]:
                    q = rank.get((x, y))
                    if q is not None and q < until_x and q <= until_y:
                        found = False
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition on a byte: (state, tokens emitted)."""
        suffix, last, count = self.keys[state]
        text = suffix + bytes((byte,))
        for i in range(len(text)):
            token = self.ids.get(text[i:])
            if token is not None and (last[i] < 0 or self._fit(last[i], token)):
                break
        emitted = count[i] + 1
        lasts, counts = (*last, token), (*(c - emitted for c in count), 0)
        for i in range(len(text) + 1):
            if i == len(text) or text[i:] in self.prefixes:
                break
        made = self._state((text[i:], lasts[i:], counts[i:])), emitted
        self.step[state][byte] = made
        return made

    def count(self, piece: bytes) -> int:
        if len(self.keys) > MEMORY_STATES:
            self._restart()
        state, total, step = 0, 0, self.step
        for b in piece:
            went = step[state].get(b)
            if went is None:
                went = self._compile(state, b)
            state, emitted = went
            total += emitted
        return total


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts of whole texts; special strings inside texts count one each, as the library does by default."""

    def __init__(self, path: str, classes: bytes):
        made = json.loads(open(path, encoding="utf-8").read())
        before, model = made["pre_tokenizer"], made["model"]
        if made["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE with its own pattern and no normaliser is compiled")
        byte_of = _byte_of()
        raw = lambda t: bytes(byte_of[c] for c in t)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = [t["content"] for t in made["added_tokens"]]
        vocabulary = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merger = MergeTransducer(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.cutter = PieceCutter(np.frombuffer(zlib.decompress(classes), np.uint8))
        self.known: dict[str, int] = {}
        self.salt = mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        with np.errstate(over="ignore"):
            base = 0x9E3779B97F4A7C15 | 1
            p, q = np.full(BATCH_CHARS * 2, base, np.uint64), np.full(BATCH_CHARS * 2, pow(base, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            self.power, self.back = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)

    def _batch(self, segments: list[str]) -> np.ndarray:
        """Token counts of texts without special strings, BATCH_CHARS together at most, or one long text alone."""
        joined = "\0".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        kinds = self.cutter.classes[points]
        kinds[ends] = RESET
        start = self.cutter.cuts(kinds)
        start[ends] = True  # the mark between texts is a piece of its own, not counted
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(points))
        counts = np.empty(len(at), np.int64)
        for i in range(0, len(at), 200_000):
            counts[i : i + 200_000] = self._pieces(joined, points, at[i : i + 200_000], stop[i : i + 200_000])
        counts[np.searchsorted(at, ends)] = 0
        total = np.concatenate(([0], np.cumsum(counts)))
        edge = np.searchsorted(at, ends, side="right")
        return total[edge] - np.concatenate(([0], total[edge[:-1]]))

    def _pieces(self, joined: str, points: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        low, high = int(at[0]), int(stop[-1])
        if high - low > len(self.power) - 1:  # a piece of over a million characters: one by one
            return np.array([self._one(joined[a:b]) for a, b in zip(at, stop, strict=True)], np.int64)
        with np.errstate(over="ignore"):
            acc = np.empty(high - low + 1, np.uint64)
            acc[0] = 0
            np.cumsum(self.salt[points[low:high]] * self.power[: high - low], out=acc[1:])
            hashed = (acc[stop - low] - acc[at - low]) * self.back[at - low]
        first, back = distinct(points, at, stop, hashed)
        known, found = self.known, np.empty(len(first), np.int64)
        if len(known) > MEMORY_PIECES:
            known.clear()
        for i, (a, b) in enumerate(zip(at[first].tolist(), stop[first].tolist(), strict=True)):
            piece = joined[a:b]
            n = known.get(piece)
            found[i] = self._one(piece) if n is None else n
        return found[back]

    def _one(self, piece: str) -> int:
        n = self.merger.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 64:
            self.known[piece] = n
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        out, group, owner, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal group, owner, size
            if group:
                np.add.at(out, owner, self._batch(group))
            group, owner, size = [], [], 0

        for i, text in enumerate(texts):
            parts = [text]
            for mark in self.special:
                parts = [x for p in parts for x in p.split(mark)]
            out[i] += len(parts) - 1
            for part in parts:
                if part:
                    if size + len(part) > BATCH_CHARS:
                        flush()
                    group.append(part)
                    owner.append(i)
                    size += len(part) + 1
        flush()
        return out


@lru_cache(maxsize=2)
def counter(path: str, classes: bytes) -> TokenCounter:
    """Compiled once for each Python worker."""
    return TokenCounter(path, classes)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE tokenizer.json, readable on every executor. A null text counts as
    empty: no bytes, no tokens. Null and repeated ids come back as they are; other columns are not read. Whole texts
    are counted, however long; one text's pieces are what a worker holds. No rows: no rows.
    """
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(tokenizer, classes)
        claim("counts", made.known.clear)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = made.counts(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.record_batch(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
