"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import claim, distinct, mix, stream

ORDER = 4
#: The sample to fit on: so many documents of a language at most, of texts of so many characters at most.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Every CALIBRATE-th sampled document is not fitted on: its cross-entropy sets the language's limit.
CALIBRATE = 5
#: A language's limit is this quantile of what its calibration documents cost, less the slack of their size, times MARGIN
#: (and, as n documents may miss what is rare, times 1 + 1 / n).
QUANTILE, MARGIN = 0.99, 1.6
#: Calibration documents from which a language has a limit of its own; below, that of all languages holds.
OWN_LIMIT = 5
#: Short texts vary more: the limit is wider by this over the root of the text's size.
SLACK = 4.0
#: A document's evidence counts as that of so many characters at most, for its score.
EVIDENCE = 50
#: Characters of a batch of documents; a longer text is scored in parts. Words that a worker remembers, and the longest of them.
BATCH_CHARS, MEMORY_WORDS, MEMORY_LETTERS = 1 << 18, 150_000, 40
START, STOP = 0, 1

_GRAM = stream(31, ORDER)
_POINT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = _runs(_letters()[points])
    return [low[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """For each position, the hash of the k points that end there (of garbage before position k - 1)."""
    with np.errstate(over="ignore"):
        h = np.full(len(points), k, np.uint64) * _POINT
        for j in range(k):
            h[j:] += (points[: len(points) - j] + np.uint64(2)) * _GRAM[j]
        return mix(h)


class KneserNey:
    """One model for each language, over the words of letters with a start and a stop mark.

    For each order: sorted hashes of the grams of any language with what each language gives them (discounted share),
    and sorted hashes of their contexts with each language's weight of the shorter context. Absent grams have share 0,
    absent contexts weight 1. ``limits``: the cross-entropy beyond which a language's document is rejected.
    """

    def __init__(self, languages: list[str], grams: list, contexts: list, base: np.ndarray):
        self.languages, self.grams, self.contexts, self.base = languages, grams, contexts, base
        self.limits = np.full(len(languages), np.inf)

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> KneserNey:
        """``counts``: lang, word (letters), n."""
        languages = sorted(counts["lang"].unique())
        tables: list[list[dict]] = []
        alphabet = set()
        for lang in languages:
            own = counts[counts["lang"] == lang]
            raw: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for word, n in zip(own["word"], own["n"], strict=True):
                marked = chr(START) + word + chr(STOP)
                for i in range(1, len(marked)):
                    alphabet.add(marked[i])
                    for k in range(1, min(ORDER, i + 1) + 1):
                        raw[k][marked[i + 1 - k : i + 1]] += n
            kept: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for k in range(1, ORDER + 1):  # lower orders count what may stand before, save at a word's start
                for gram, n in raw[k].items():
                    if k == ORDER or gram[0] == chr(START):
                        kept[k][gram] = n
                if k > 1:
                    for gram in raw[k]:
                        if gram[1:2] != chr(START):
                            kept[k - 1][gram[1:]] += 1
            tables.append(kept)
        size = len(languages)
        grams, contexts, base = [None], [None], np.zeros(size)
        for k in range(1, ORDER + 1):
            share: dict[str, np.ndarray] = {}
            rest: dict[str, np.ndarray] = {}
            for li, kept in enumerate(tables):
                ones, twos = (sum(1 for n in kept[k].values() if n == m) for m in (1, 2))
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = Counter(), Counter()
                for gram, n in kept[k].items():
                    total[gram[:-1]] += n
                    kinds[gram[:-1]] += 1
                for gram, n in kept[k].items():
                    share.setdefault(gram, np.zeros(size, np.float32))[li] = max(n - discount, 0) / total[gram[:-1]]
                for context, n in total.items():
                    rest.setdefault(context, np.ones(size, np.float32))[li] = discount * kinds[context] / n
            if k == 1:
                base = rest[""].astype(np.float64) / (len(alphabet) + 1)
                contexts.append(None)
            else:
                contexts.append(cls._sorted(rest, k - 1))
            grams.append(cls._sorted(share, k))
        return cls(languages, grams, contexts, base)

    @staticmethod
    def _sorted(values: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        points = np.array([[ord(c) for c in gram] for gram in values], np.uint64).reshape(-1)
        keys = _gram_hashes(points, k)[k - 1 :: k]
        order = np.argsort(keys)
        return keys[order], np.stack([*values.values()])[order]

    @staticmethod
    def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, absent: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        found = table[1][at].astype(np.float64)
        found[table[0][at] != keys] = absent
        return found

    def word_costs(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Minus log probability of each word in each language; ``points`` has the words' letters one after another."""
        starts = np.cumsum(lengths + 2) - (lengths + 2)
        marked = np.full(len(points) + 2 * len(lengths), STOP, np.uint64)
        place = np.arange(len(points)) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)
        marked[place] = points
        marked[starts] = START
        depth = np.arange(len(marked)) - np.repeat(starts, lengths + 2)
        at = np.flatnonzero(depth > 0)
        p = self._look_up(self.grams[1], _gram_hashes(marked, 1)[at], 0) + self.base
        for k in range(2, ORDER + 1):
            deep = np.flatnonzero(depth[at] >= k - 1)
            where = at[deep]
            weight = self._look_up(self.contexts[k], _gram_hashes(marked, k - 1)[where - 1], 1)
            p[deep] = self._look_up(self.grams[k], _gram_hashes(marked, k)[where], 0) + weight * p[deep]
        costs = -np.log(p)
        return np.add.reduceat(costs, np.cumsum(lengths + 1) - (lengths + 1)) if len(lengths) else np.empty((0, len(self.languages)))

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Minus log probability of each text in each language, and the number of its letters and word ends."""
        cost, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                c, n = self._batch([t for _, t in group])
                owner = np.array([i for i, _ in group])
                np.add.at(cost, owner, c)
                np.add.at(size, owner, n)
            group, held = [], 0

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = at + BATCH_CHARS
                while end < len(text) and text[end].isalpha():
                    end += 1  # a word stays whole
                part = text[at:end]
                if held + len(part) > BATCH_CHARS:
                    flush()
                group.append((i, part))
                held += len(part)
                at = end
        flush()
        return cost, size

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lows = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lows])
        joined = "\0".join([*lows, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        a, b = _runs(_letters()[points])
        out = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts), np.int64)
        if not len(a):
            return out, size
        with np.errstate(over="ignore"):
            acc = np.zeros(len(points) + 1, np.uint64)
            power, back = _powers(len(points))
            np.cumsum(mix(points * _POINT) * power, out=acc[1:])
            hashed = (acc[b] - acc[a]) * back[a]
        first, back_to = distinct(points, a, b, hashed)
        costs = self._known(joined, points, a[first], b[first])[back_to]
        owner = np.searchsorted(ends, a, side="right")
        for li in range(len(self.languages)):
            out[:, li] = np.bincount(owner, costs[:, li], len(texts))
        size += np.bincount(owner, b - a + 1, len(texts)).astype(np.int64)
        return out, size

    def _known(self, joined: str, points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Costs of distinct words, the shorter ones remembered from batch to batch; a worker remembers those of one
        model only."""
        claim("languages", _memory.clear)
        if _memory.get("model") is not self or len(_memory["rows"]) > MEMORY_WORDS:
            _memory.clear()
            _memory.update(model=self, rows={}, costs=np.empty((0, len(self.languages))))
        rows, held = _memory["rows"], _memory["costs"]
        get = rows.get
        words = [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        row = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(row < 0)
        out = np.empty((len(words), len(self.languages)))
        out[row >= 0] = held[row[row >= 0]]
        if len(new):
            lengths = b[new] - a[new]
            inside = np.repeat(a[new] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            out[new] = self.word_costs(points[inside].astype(np.uint64), lengths)
            short = new[lengths <= MEMORY_LETTERS]
            first = len(rows)
            rows.update(zip([words[i] for i in short.tolist()], range(first, first + len(short)), strict=True))
            if len(rows) > len(held):
                grown = np.empty((max(2 * len(held), len(rows)), len(self.languages)))
                grown[:first] = held[:first]
                held = _memory["costs"] = grown
            held[first : len(rows)] = out[short]
        return out

    def calibrate(self, texts: pd.DataFrame) -> None:
        """Limits from documents (lang, text) that the model wasn't fitted on.

        A language's limit is what its own documents cost at most, but for a hundredth, less the slack of each one's
        size, and MARGIN times that. Languages with few documents share the limit of all documents in their own models.
        """
        cost, size = self.costs(texts["text"].tolist())
        each = cost / np.maximum(size, 1)[:, None] - SLACK / np.sqrt(np.maximum(size, 1))[:, None]
        at = {lang: li for li, lang in enumerate(self.languages)}
        place = np.array([at.get(lang, -1) for lang in texts["lang"]], np.int64)
        usable = (place >= 0) & (size > 0)
        own = each[np.arange(len(each)), place]
        if usable.any():
            self.limits[:] = _limit(own[usable])
        for li in range(len(self.languages)):
            mine = own[usable & (place == li)]
            if len(mine) >= OWN_LIMIT:
                self.limits[li] = _limit(mine)


def _limit(costs: np.ndarray) -> float:
    return float(np.quantile(costs, QUANTILE)) * MARGIN * (1 + 1 / len(costs))


_memory: dict = {}
_power_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power_tables or len(_power_tables[0]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        made = []
        with np.errstate(over="ignore"):
            for x in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, BATCH_CHARS + 4096), x, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        _power_tables[:] = made
    return _power_tables[0][:n], _power_tables[1][:n]


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KneserNey:
    """A model of each language that the documents name, from a bounded sample of them.

    Learns from documents with a text and a language whose crc32(id) mod 3 is not 1 (null ids are not learned from):
    SAMPLE_DOCS for each language, those with the smallest hashes of the id, among texts of SAMPLE_CHARS characters at
    most. The driver gets the sample: SAMPLE_DOCS * SAMPLE_CHARS characters for each language at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("id")))
    rows = rows.where(F.length("text") <= SAMPLE_CHARS).where(r"text rlike '\\p{L}'")
    rows = rows.select("text", "lang", F.xxhash64(F.lit(7), "id").alias("h"))
    span = 1 << 20
    share = F.pmod("h", F.lit(span))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return KneserNey([], [], [], np.zeros(0))
    rate = F.lit(0)
    for lang, n in counts.items():  # some more than needed, so that chance leaves enough
        rate = F.when(F.col("lang") == lang, int(span * min(1.0, (1.3 * SAMPLE_DOCS + 100) / n)) + 1).otherwise(rate)
    chosen = rows.where(share < rate).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY pmod(h, 1048576), h, md5(text))"))
    sample = chosen.where(F.col("rank") <= SAMPLE_DOCS).select("lang", "rank", "text").toPandas().sort_values(["lang", "rank"])
    apart = sample["rank"] % CALIBRATE == 0
    words = Counter()
    for lang, text in zip(sample["lang"][~apart], sample["text"][~apart], strict=True):
        words.update((lang, w) for w in letter_words(text))
    model = KneserNey.fit(pd.DataFrame([(k, w, n) for (k, w), n in words.items()], columns=["lang", "word", "n"]))
    model.calibrate(sample[apart])
    return model


def language_of(docs: DataFrame, model: KneserNey, text: str = "text") -> F.Column:
    """A struct column (lang_pred, score, rejected) for the texts of ``docs``; see ``identify_languages``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = sent.value
        for batch in batches:
            parts = [_judged(made, [t or "" for t in batch.iloc[i : i + 256]]) for i in range(0, len(batch), 256)]
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    return judge(F.col(text))


def _judged(model: KneserNey, texts: list[str]) -> pd.DataFrame:
    names = np.array([*model.languages, "und"], object)
    if not model.languages:
        return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
    cost, size = model.costs(texts)
    each = cost / np.maximum(size, 1)[:, None]
    best = each.argmin(axis=1)
    low = each[np.arange(len(texts)), best]
    ratio = np.exp(-(each - low[:, None]) * np.minimum(size, EVIDENCE)[:, None])
    return pd.DataFrame({
        "lang_pred": names[np.where(size > 0, best, len(model.languages))],
        "score": np.where(size > 0, 1 / ratio.sum(axis=1), 0.0),
        "rejected": (low > model.limits[best] + SLACK / np.sqrt(np.maximum(size, 1))) | (size == 0),
    })


def identify_languages(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected.

    The language with the lowest cross-entropy for each letter or word end; equal ones: the first by name. The score is
    that language's share of the likelihoods, of EVIDENCE characters at most. ``rejected`` says that even the chosen
    language's cross-entropy lies beyond its calibrated limit. A null text, or one without letters, is ``und`` with
    score 0, and rejected; so is every text if no language was learned. Ids come back as they are, null and repeated
    ones too (a null id is not held out); no other column is read. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.select("id", language_of(rows, model).alias("found"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "found.*")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, fit_languages(docs))
