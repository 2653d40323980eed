"""Audio fingerprints of media columns: pitch-class frames, integral-image filters, offset histograms and bit errors.

The public tables have no recordings. ``render_turns`` makes some: it plays each turn of a conversation word by word, so
that equal and shared texts give equal and shared sound. The operator itself reads WAV columns.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Samples a second to which recordings are brought; samples of a frame, and from one frame to the next.
RATE, FRAME, HOP = 2048, 512, 128
#: Bins of sound that are heard, in Hz.
LOWEST, HIGHEST = 60.0, 1000.0
#: Frames of a filter at most; a recording needs so many frames to have a fingerprint.
SPAN = 16
#: Shares of bits that may differ, and frames that must overlap, for two recordings to be aligned.
ERRORS, OVERLAP = 0.15, 24
#: Every frame on both sides proposes pairs: two fingerprint integers APART frames from one another that agree in one of
#: KEYS sub-keys (KEY_BITS neighbouring bits of each, in a circle), and differ in NEAR of their 64 bits at most, propose an
#: offset. It is compared in full if of the bits of LOOKS frames, spread over the overlap, a share of LOOSE differs at most.
KEYS, KEY_BITS, APART, NEAR, LOOKS, LOOSE = 8, 12, 8, 12, 12, 0.3
#: Values by which sub-keys are looked up (in bits).
SLOTS = 21
#: Frames of the queries that are sent to every task at a time, and frames, hits and compared frames handled at a time.
BLOCK_FRAMES, PART_FRAMES, HITS = 1 << 21, 1 << 16, 1 << 21

# Fixed values. Filters over [frame, pitch class], as the public library Chromaprint has them by default (with limits of our own): kind, first class, classes, frames. Kinds: 0 the whole area, 1 upper
# against lower classes, 2 earlier against later frames, 3 checks, 4 middle frames against outer, 5 middle classes
# against outer. Two bits each, by the limits that follow.
FILTERS = [
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
]
LIMITS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(blob: bytes | None) -> np.ndarray:
    """Mono samples at RATE, -1 to 1; nothing from a null, empty or unreadable recording."""
    if not blob:
        return np.empty(0, np.float32)
    try:
        with wave.open(io.BytesIO(blob)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0, np.float32)
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
    if kind is None or not channels or not rate:
        return np.empty(0, np.float32)
    n = len(raw) // (width * channels)
    sound = np.frombuffer(raw, kind, n * channels).astype(np.float32).reshape(-1, channels).mean(axis=1)
    sound = (sound - 128) / 128 if width == 1 else sound / float(1 << (8 * width - 1))
    if rate != RATE and n:
        sound = np.interp(np.arange(int(n * RATE / rate)) * (rate / RATE), np.arange(n), sound).astype(np.float32)
    return sound


@lru_cache(maxsize=1)
def _pitches() -> tuple[np.ndarray, np.ndarray]:
    """The window, and the share of each frequency bin in each pitch class."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    heard = (hertz >= LOWEST) & (hertz <= HIGHEST)
    classes = np.zeros((len(hertz), 12), np.float32)
    pitch = np.round(12 * np.log2(hertz[heard] / 440.0)).astype(int) % 12
    classes[np.flatnonzero(heard), pitch] = 1
    return np.hanning(FRAME).astype(np.float32), classes


def chroma(sound: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, of length 1; silent frames are 0."""
    n = (len(sound) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    window, classes = _pitches()
    out = []
    for at in range(0, n, 4096):  # long recordings in parts
        m = min(4096, n - at)
        frames = np.lib.stride_tricks.as_strided(
            sound[at * HOP :], (m, FRAME), (sound.strides[0] * HOP, sound.strides[0]), writeable=False
        )
        out.append((np.abs(np.fft.rfft(frames * window, axis=1)) ** 2).astype(np.float32) @ classes)
    energy = np.concatenate(out)
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(size > 1e-3, energy / np.maximum(size, 1e-9), 0)


def fingerprint(sound: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame but the last SPAN - 1: two bits of each filter, over an integral image."""
    image = chroma(sound)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    wide = np.concatenate((image, image[:, :11]), axis=1)  # classes go round
    sums = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    sums[1:, 1:] = wide.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        at = np.arange(n)
        return sums[at + t1, c1] - sums[at + t0, c1] - sums[at + t1, c0] + sums[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        whole, ch, cw = area(0, w, c, c + h), c + h // 2, w // 2
        if kind == 0:
            part = whole / 2
        elif kind == 1:
            part = area(0, w, ch, c + h)
        elif kind == 2:
            part = area(cw, w, c, c + h)
        elif kind == 3:
            part = area(0, cw, ch, c + h) + area(cw, w, c, ch)
        elif kind == 4:
            part = area(w // 3, w - w // 3, c, c + h)
        else:
            part = area(0, w, c + h // 3, c + h - h // 3)
        rest = whole - part if kind else np.full(n, h * w / 24)
        value = np.log((1 + part) / (1 + rest))
        out |= GRAY[np.searchsorted(LIMITS, np.round(value, 9), side="right")] << np.uint32(2 * k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            found = [fingerprint(read_wav(b.as_py())).astype("<u4").tobytes() for b in part.column(1)]
            digests = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
            yield pa.record_batch([part.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["id", "digest", "prints"])


def _sub_keys(prints: np.ndarray, k: int) -> np.ndarray:
    """The slot of each frame's k-th sub-key; the last APART frames are paired with others and mean nothing."""
    wide = prints.astype(np.uint64) * np.uint64((1 << 32) + 1)  # the 32 bits twice: any window is in one piece
    mask = np.uint64((1 << KEY_BITS) - 1)
    here = (wide >> np.uint64(32 * k // KEYS)) & mask
    there = (np.roll(wide, -APART) >> np.uint64((32 * k // KEYS + 16) % 32)) & mask
    with np.errstate(over="ignore"):
        return ((((here << np.uint64(KEY_BITS)) | there) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


class _Index:
    """The fingerprints of some queries; for each sub-key their frames in its order, and where each value begins."""

    def __init__(self, nodes: list[int], blobs: list[bytes]):
        self.nodes = np.array(nodes, np.int64)
        self.prints, self.owner, self.starts, self.lengths = _joined(blobs)
        use = _paired(self.prints, self.owner)
        self.tables = []
        for k in range(KEYS):
            keys = _sub_keys(self.prints, k)[use]
            begins = np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=1 << SLOTS))))
            self.tables.append((use[np.argsort(keys, kind="stable")].astype(np.int32), begins.astype(np.int32)))

    def aligned(self, nodes: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        """Aligned pairs with others: a, b, offset, overlap, bit errors."""
        prints, owner, starts, lengths = _joined(blobs)
        codes = [np.empty(0, np.int64)]
        use = _paired(prints, owner)
        for k, (order, begins) in enumerate(self.tables):
            keys = _sub_keys(prints, k)
            many = (begins[keys + 1] - begins[keys]).astype(np.int64)
            hit = use[many[use] > 0]
            ends = np.cumsum(many[hit])
            cuts = np.searchsorted(ends, np.arange(HITS, ends[-1], HITS)) if len(ends) else []
            for part in np.split(hit, cuts):
                m = many[part]
                fb = np.repeat(part, m)
                fa = order[np.repeat(begins[keys[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                differ = np.bitwise_count(prints[fb] ^ self.prints[fa]) + np.bitwise_count(prints[fb + APART] ^ self.prints[fa + APART])
                near = np.flatnonzero(differ <= NEAR)
                fa, fb = fa[near].astype(np.int64), fb[near]
                a, b = self.owner[fa], owner[fb]
                offset = (fb - starts[b]) - (fa - self.starts[a])
                overlap = np.minimum(self.lengths[a], lengths[b] - offset) - np.maximum(0, -offset)
                fit = (overlap >= OVERLAP) & (self.nodes[a] != nodes[b])
                codes.append(np.unique(((a * len(blobs) + b) << 32 | (offset + (1 << 31)))[fit]))
        code = np.unique(np.concatenate(codes))
        pair, offset = code >> 32, (code & 0xFFFFFFFF) - (1 << 31)
        a, b = pair // len(blobs), pair % len(blobs)
        low = np.maximum(0, -offset)
        overlap = np.minimum(self.lengths[a], lengths[b] - offset) - low
        bits = np.zeros(len(code), np.int64)
        first_a, first_b = self.starts[a] + low, starts[b] + low + offset
        for i in range(LOOKS):
            place = overlap * (2 * i + 1) // (2 * LOOKS)
            bits += np.bitwise_count(self.prints[first_a + place] ^ prints[first_b + place])
        chosen = np.flatnonzero(bits <= LOOSE * 32 * LOOKS)
        a, b, pair, offset, low, overlap, code = (x[chosen] for x in (a, b, pair, offset, low, overlap, code))
        bits = np.zeros(len(code), np.int64)
        at = 0
        while at < len(code):
            n = np.cumsum(overlap[at : at + HITS // OVERLAP])
            to = at + max(1, int(np.searchsorted(n, HITS, side="right")))
            n = overlap[at:to]
            first = np.cumsum(n) - n
            step = np.arange(n.sum())
            fa = np.repeat(self.starts[a[at:to]] + low[at:to] - first, n) + step
            fb = np.repeat(starts[b[at:to]] + low[at:to] + offset[at:to] - first, n) + step
            bits[at:to] = np.add.reduceat(np.bitwise_count(self.prints[fa] ^ prints[fb]), first, dtype=np.int64)
            at = to
        errors = bits / (32 * np.maximum(overlap, 1))
        good = np.flatnonzero(errors <= ERRORS)
        good = good[np.lexsort((offset[good], (bits - 32 * overlap)[good], pair[good]))]
        good = good[np.concatenate(([True], pair[good][1:] != pair[good][:-1]))] if len(good) else good
        return self.nodes[a[good]], nodes[b[good]], offset[good], overlap[good], errors[good]


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Fingerprints one after another; the recording of each frame; where each recording begins, and its frames."""
    lengths = np.array([len(b) // 4 for b in blobs], np.int64)
    prints = np.frombuffer(b"".join(blobs), "<u4").astype(np.uint32)
    return prints, np.repeat(np.arange(len(blobs)), lengths), np.cumsum(lengths) - lengths, lengths


def _paired(prints: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Frames whose recording has one APART frames later; of a run in which both stay the same, the first and the last.

    A constant sound, silence above all, would propose each of its frames with each of the other's, and all for the
    offsets that its ends propose."""
    use = np.flatnonzero(owner[:-APART] == owner[APART:])
    same = (np.diff(use) == 1) & (owner[use[1:]] == owner[use[:-1]])
    same &= (prints[use[1:]] == prints[use[:-1]]) & (prints[use[1:] + APART] == prints[use[:-1] + APART])
    inner = np.zeros(len(use), bool)
    inner[1:-1] = same[:-1] & same[1:]
    return use[~inner]


_memory: dict = {}


def _aligner(sent):
    """A function for mapInArrow: rows (node, prints) against a broadcast block of queries (nodes, prints)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        if _memory.get("block") is not block:  # a worker keeps the index of one block
            _memory.clear()
            _memory.update(block=block, index=_Index(*block))
        index = _memory["index"]
        for batch in batches:
            nodes, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(blobs):
                to, held = at + 1, len(blobs[at]) // 4
                while to < len(blobs) and to < at + 1000 and held + len(blobs[to]) // 4 <= PART_FRAMES:
                    held += len(blobs[to]) // 4
                    to += 1
                a, b, offset, overlap, errors = index.aligned(nodes[at:to], blobs[at:to])
                yield pa.record_batch(
                    [pa.array(a), pa.array(b), pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(errors)],
                    names=["a", "b", "offset", "overlap", "bit_errors"],
                )
                at = to

    return align


def _blocks(rows: Iterator) -> Iterator[tuple[list[int], list[bytes]]]:
    nodes, blobs, held = [], [], 0
    for node, prints in rows:
        if held and held + len(prints) // 4 > BLOCK_FRAMES:
            yield nodes, blobs
            nodes, blobs, held = [], [], 0
        nodes.append(node)
        blobs.append(bytes(prints))
        held += len(prints) // 4
    if nodes:
        yield nodes, blobs


def align_recordings(media: DataFrame, queries: F.Column, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """One row per recording: id, n_prints, class_id, is_query, matches.

    Recordings with equal fingerprints are a class; class_id is its smallest id. ``matches``, for recordings of classes
    with a query in them: the other classes aligned with it, as structs (class_id, offset, overlap, bit_errors) in
    order. A pair is aligned at an offset if the overlap has OVERLAP frames or more and ERRORS of its bits differ at most;
    of several such offsets that are proposed, the one with most equal bits (then the smallest) counts. Candidate offsets come from sub-keys
    of single fingerprint integers, of every frame on both sides (of a constant run, its ends), and each is compared bit
    by bit. All classes are read
    once for each BLOCK_FRAMES frames of queries; nothing but aligned pairs is shuffled or written.

    Null, empty and unreadable recordings, and those too short for a fingerprint, have no prints, no class_id and no
    matches. Null ids are kept, but a class of null ids alone has no class_id. Repeated rows come back as often as they
    went in. Other columns are not read. No rows: no rows.
    """
    space = Workspace(media.sparkSession, "chroma")
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio"))
    prints = space.table(rows.mapInArrow(_fingerprints, "id long, digest binary, prints binary"), "prints")
    asked = prints.withColumn("q", F.coalesce(queries(F.col("id")), F.lit(False)))
    classes = asked.where("length(prints) > 0").groupBy("digest").agg(
        F.min("id").alias("class_id"), F.max("q").alias("q"), F.first("prints").alias("prints")
    )
    classes = space.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = 4 * OVERLAP
    long = classes.where(F.length("prints") >= least).select("node", "prints")
    form = "a long, b long, offset int, overlap int, bit_errors double"
    aligned = media.sparkSession.createDataFrame([], form)
    for block in _blocks(classes.where(F.col("q") & (F.length("prints") >= least)).select("node", "prints").toLocalIterator()):
        sent = media.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_FRAMES
        aligned = aligned.unionByName(space.table(long.mapInArrow(_aligner(sent), form), "aligned"))
        sent.unpersist()
    named = aligned.join(classes.select(F.col("node").alias("b"), "class_id").hint("merge"), "b")
    entry = F.struct("class_id", "offset", "overlap", F.round("bit_errors", 6).alias("bit_errors"))
    found = named.groupBy("a").agg(F.array_sort(F.collect_list(entry)).alias("matches"))
    known = classes.select("node", "digest", "class_id").join(found.withColumnRenamed("a", "node").hint("merge"), "node", "left")
    known = space.table(known.select("digest", "class_id", "matches"), "known")
    out = asked.select("id", "digest", "q", (F.length("prints") / 4).cast("long").alias("n_prints")).join(known.hint("merge"), "digest", "left")
    empty = F.array().cast("array<struct<class_id:bigint,offset:int,overlap:int,bit_errors:double>>")
    return out.select(F.col("id").alias(id_col), "n_prints", "class_id", F.col("q").alias("is_query"), F.coalesce("matches", empty).alias("matches"))


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    note = np.arange(256) / RATE
    tones = [(127 * np.sin(2 * np.pi * 110.0 * 2 ** (p / 12) * note) * np.hanning(256) ** 0.25 + 128).astype(np.uint8) for p in range(36)]
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            blobs = []
            for text in part.column(1).to_pylist():
                sound = b"".join(tones[zlib.crc32(w.encode("utf-8", "surrogatepass")) % 36].tobytes() for w in (text or "").lower().split())
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(1)
                    w.setframerate(RATE)
                    w.writeframes(sound)
                blobs.append(out.getvalue() if text is not None else None)
            yield pa.record_batch([part.column(0), pa.array(blobs, pa.binary())], names=["id", "audio"])


def render_turns(conversations: DataFrame) -> DataFrame:
    """id (conv_id * 2^20 + turn) and a WAV column: an eighth of a second for each word, in a pitch that the word decides."""
    rows = conversations.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("id"), "text")
    return rows.mapInArrow(_played, "id long, audio binary")


def op7_chroma_prints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all turns; every one whose id is divisible by 20 is aligned with all."""
    media = render_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return align_recordings(media, lambda i: i % 20 == 0)
