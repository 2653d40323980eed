"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .store import Workspace

BINS, BANDS = 128, 32
#: Centers that a bucket which still holds several components offers from its largest one, in each later round, besides the
#: one with most links; and from the others. The last round is for members that have looked like others without a link.
DRAWN, OTHERS = (2, 16), 2
THRESHOLD = 75
#: Of 128 four-bit sketches, those of a linked pair agree in 98 on average, with a deviation of 4.8; in fewer than this
#: with a probability of 1e-9.
AGREEING = 69


def _donors() -> np.ndarray:
    """For each bin its own random order of all bins, which an empty bin tries until one has a value."""
    return np.argsort(hashing.stream(21, BINS * BINS).reshape(BINS, BINS), axis=1, kind="stable")


_DONORS = _donors()
_ROW = hashing.stream(22, BINS // BANDS)
_BAND = hashing.stream(23, BANDS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each bin of a sorted set; empty bins take a random other bin's (optimal densification).

    The bin is the hash's leading bits, so that the first element of a bin in sorted order is its minimum.
    """
    at = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    full = np.diff(np.append(at, len(shingles))) > 0
    if not full.all():
        empty = np.flatnonzero(~full)
        donor = _DONORS[empty]
        at[empty] = at[donor[np.arange(len(empty)), full[donor].argmax(axis=1)]]
    return shingles[at]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = signature(shingles).reshape(BANDS, -1)
        return hashing.mix((rows * _ROW).sum(axis=1, dtype=np.uint64) + _BAND)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Four bits of each bin's value, in eight words."""
    bits = (signature(shingles) & np.uint64(15)).reshape(8, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return bits.sum(axis=1, dtype=np.uint64)


def _may_be_linked(na: F.Column, a: F.Column, nb: F.Column, b: F.Column) -> F.Column:
    """Whether set sizes allow the threshold, and sketches agree in AGREEING bins at least."""
    differ = F.lit(0)
    for i in range(8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for k in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (100 * F.least(na, nb) >= THRESHOLD * F.greatest(na, nb)) & (differ <= BINS - AGREEING)


@hashing.given_back
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            ids, digests, counts, bands, sketches = part.column(0), [], [], [], []
            for text in part.column(1):
                joined = hashing.words_of(text.as_py())
                found = hashing.shingle_set(hashing.word_hashes(joined))
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                counts.append(len(found))
                bands.append(band_keys(found).view(np.int64) if len(found) else None)
                sketches.append(sketch(found).view(np.int64) if len(found) else None)
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [ids, pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)],
                names=["id", "digest", "n", "bands", "sketch"],
            )


@hashing.given_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            digests, found = [], []
            for text in part.column(0):
                joined = hashing.words_of(text.as_py())
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                found.append(hashing.shingle_set(hashing.word_hashes(joined)).view(np.int64))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["digest", "shingles"])


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, at every size: AQE can split a hot key's rows, and nothing is sent whole to all tasks."""
    return left.join(right.hint("merge"), on, how)


def _centered(member: DataFrame) -> DataFrame:
    """The members (bucket, node) of buckets that hold several nodes, and their bucket's center: the node that comes first
    in one drawn order of all nodes, so that buckets which share many members have few centers and propose few pairs."""
    drawn = F.struct(F.xxhash64("node").alias("h"), "node")
    center = member.groupBy("bucket").agg(F.min(drawn).alias("c"), F.max("node").alias("hi"), F.min("node").alias("lo")).where("lo <> hi")
    return _join(member, center.select("bucket", F.col("c.node").alias("center")), "bucket")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked."""
    for k in "ba":
        pairs = _join(pairs, sketches.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")), k)
    return pairs.where(_may_be_linked(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are alike enough."""
    for k in "ba":
        pairs = _join(pairs, sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")), k)
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(100 * both >= THRESHOLD * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    return _join(members.select("bucket", "node"), comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components."""
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return _join(placed, several.select("bucket"), "bucket", "left_semi")


def _stars(mixed: DataFrame, asked: DataFrame, links: DataFrame, drawn: int) -> DataFrame:
    """Pairs that may be linked, of every member asked for that is outside its bucket's largest component, with a bounded
    number of centers: of the largest component, the member with most links and some others drawn; of the rest, OTHERS
    that aren't of the member's component. ``mixed`` and ``asked`` hold the members' sketches."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    who = F.struct("node", "n", "sketch").alias("who")
    lot = lambda i: F.struct(F.xxhash64(F.lit(drawn), F.lit(i), "node", "bucket").alias("h"), who)
    hub = F.struct(F.coalesce("degree", F.lit(0)).alias("h"), who)
    parts = _join(mixed, degree, "node", "left").groupBy("bucket", "component").agg(
        F.count("*").alias("members"), F.max(hub).alias("hub"), *(F.max(lot(i)).alias(f"d{i}") for i in range(drawn))
    )
    own = F.array("hub.who", *(f"d{i}.who" for i in range(drawn)))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("members", "component", own.alias("centers"))).alias("c"))
    largest = largest.select("bucket", F.col("c.component").alias("most"), "c.centers")
    rest = _join(parts, largest, "bucket").where("component <> most").groupBy("bucket")
    centers = rest.agg(F.first("most").alias("most"), F.first("centers").alias("centers"), *(F.max(F.struct(f"d{i}", "component")).alias(f"o{i}") for i in range(OTHERS)))
    others = F.array(*(F.when(F.col(f"o{i}.component") != F.col("component"), F.col(f"o{i}.d{i}.who")) for i in range(OTHERS)))
    pairs = _join(asked, centers, "bucket").where("component <> most").withColumn("all", F.concat("centers", F.array_compact(others)))
    alike = F.filter("all", lambda c: _may_be_linked(F.col("n"), F.col("sketch"), c["n"], c["sketch"]))
    return _ordered(pairs.select("node", F.explode(F.transform(alike, lambda c: c["node"])).alias("center")), "node", "center")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept.

    A document's set holds its distinct five-word shingles (of the whole sequence if shorter), each as 64 bits of a hash
    of its words' BLAKE2b digests. Two documents are linked if 100 * intersection >= 75 * union; every candidate is
    confirmed on the full sets. Equal word sequences are one class from the start. Each band bucket links its members
    to one center (a star), by one drawn order for all buckets, so that near copies, which share most buckets, don't
    confirm many links that say the same. In buckets that then still hold several components, every member outside the
    largest one meets more centers: the largest component's member with most links (the text that others were copied from has links to all of
    them), DRAWN other members of it, and OTHERS members outside it, all drawn for each bucket; then once more, with a
    larger number, those that have met a center with a similar sketch. So a member makes a bounded number of pairs for each of its 32 buckets,
    whatever their size. A link is lost only if its ends never meet and nothing else connects them; README has the
    measured recall.

    Null or empty texts and texts without words have no shingles and are their own component. A null id is never
    linked (component_id null, kept). Repeated rows come back as often as they went in. No rows: no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = space.table(rows.mapInArrow(_features, "id long, digest binary, n long, bands array<long>, sketch array<long>"), "features")

    live = feats.where("n > 0 AND id IS NOT NULL")
    one = live.groupBy("digest").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "bands", "sketch"), "id").alias("one"))
    classes = one.select("digest", "id", "one.*").withColumn("node", F.monotonically_increasing_id())
    classes = space.table(classes, "classes")  # nodes are fixed by writing
    told = space.table(feats.select("id", "digest", "n"), "told")
    space.drop(feats)
    member = classes.select(F.explode("bands").alias("bucket"), "node")
    members = space.table(_centered(member), "members")

    met = members.select("node").distinct()
    needed = space.table(_join(classes.select("id", "digest", "n", "sketch", "node"), met, "node", "left_semi"), "needed")
    sets = _join(rows, needed.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(_sets, "digest binary, shingles array<long>")
    sets = _join(sets.dropDuplicates(["digest"]), needed.select("digest", "node"), "digest").select("node", "shingles")
    sets = space.table(sets, "sets")

    likely = space.table(_likely(_ordered(members, "node", "center"), needed), "likely")
    links = space.table(_confirmed(likely, sets), "links")
    comps = connected_components(links, space)
    mixed = space.table(_mixed(_placed(members, comps)), "mixed")
    space.drop(members)
    sketches = needed.select("node", "n", "sketch")
    for turn, drawn in enumerate(DRAWN, 1):
        known = space.table(_join(mixed, sketches, "node"), "sketched")
        alike = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = _join(known, alike, "node", "left_semi") if turn > 1 else known
        fresh = space.table(_join(_stars(known, asked, links, drawn), likely, ["a", "b"], "left_anti"), "likely")
        more = space.table(_confirmed(fresh, sets), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = connected_components(links, space)
        if turn < len(DRAWN):
            likely = likely.unionByName(fresh)
            mixed = space.table(_mixed(_placed(mixed.select("bucket", "node"), comps)), "mixed")
        space.drop(known)
    space.drop(mixed, sets, needed)

    placed = _join(classes.select("digest", "id", "node"), comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = space.table(_join(placed, named, "component").select("digest", "component_id"), "named")
    space.drop(classes)
    out = _join(told, named, "digest", "left")
    whole = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        whole.alias("component_id"),
        F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"),
    )


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
