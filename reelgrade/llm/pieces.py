"""SentencePiece encoding and decoding that keeps every piece's place in the source text."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import claim

SPACE = "▁"
#: Words whose pieces a worker remembers; when half of them are new, those of the other half that weren't met again go.
MEMORY_WORDS = 250_000
#: Characters that a group of an alphabet has at least, for words to be cut where they leave it.
ALPHABET = 20
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


class CharacterMap:
    """The compiled character map of a model: a double array over source bytes, whose values point to replacements.

    Its layout is the public one of double-array tries: a unit holds a label, an offset to its children and, at a
    leaf, a value.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes | None]:
        """The longest mapped prefix of source[at:] in bytes, and its replacement; (0, None) if nothing is mapped."""
        best: tuple[int, bytes | None] = (0, None)
        if not self.units:
            return best
        node = self._child(self.units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


class PieceCodec:
    """A BPE model with byte fallback: encoding, decoding, and the source bytes of each piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or trained.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models that mark a word's start are read")
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if USER_DEFINED in kinds:
            raise ValueError(f"{path}: user-defined pieces aren't read")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.hidden = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.unknown = kinds.index(UNKNOWN)
        self.special = {*self.hidden, *self.bytes_of, self.unknown}
        self.unknown_surface = trained.unk_surface
        #: Without pieces that hold a space after something else, no merge crosses the start of a word.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = self._cutter() if self.by_word else re.compile("(?s).+")
        self.known: dict[str, tuple[bytes, bytes, str]] = {}
        self.older: dict[str, tuple[bytes, bytes, str]] = {}

    def _cutter(self) -> re.Pattern:
        """Cuts words at their starts, and where one group of characters ends and another begins: characters that stand
        side by side in any piece (word marks aside) are of one group, so that no merge crosses such a place either."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for piece in self.ids:
            inner = piece.lstrip(SPACE)
            for c in inner:
                root[find(c)] = find(inner[0])
        groups: dict[str, list[str]] = {}
        for c in root:
            groups.setdefault(find(c), []).append(c)
        large = ["".join(map(re.escape, sorted(g))) for g in groups.values() if len(g) >= ALPHABET]
        runs = [f"[{g}]+" for g in large] + [f"[^{SPACE}{''.join(large)}]+"]
        return re.compile(f"{SPACE}*(?:{'|'.join(runs)})|{SPACE}+")

    def forget(self) -> None:
        self.known.clear()
        self.older.clear()

    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its characters and its end the source byte at which it starts.

        The second is None where each character stands for itself (spaces aside), but for the word mark put in front.
        """
        if not text:
            return "", None
        if not self.map.units and not self.squeeze and SPACE not in text and "\0" not in text:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        source, at, out, origin = text.encode("utf-8", "surrogatepass"), 0, [], []
        while at < len(source):
            used, new = self.map.longest(source, at)
            if not used:
                used = 1 if source[at] < 0x80 else 2 if source[at] < 0xE0 else 3 if source[at] < 0xF0 else 4
                new = source[at : at + used]
            for c in new.decode("utf-8", "surrogatepass"):
                out.append(SPACE if c == " " else c)
                origin.append(at)
            at += used
        end = len(source)
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != SPACE or (i and out[i - 1] != SPACE)]
            while keep and out[keep[-1]] == SPACE:
                end = origin[keep.pop()]
            out, origin = [out[i] for i in keep], [origin[i] for i in keep]
        if self.prefix and out:
            out.insert(0, SPACE)
            origin.insert(0, origin[0])
        return "".join(out), np.array([*origin, end], np.int64)

    def _merge(self, word: str) -> list[str]:
        """BPE: of all neighbours that make a piece, the best scored (then the leftmost) merge first."""
        score = self.score
        if len(word) <= 64:
            get, none = score.get, -math.inf
            parts = list(word)
            scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while scores:
                best = max(scores)
                if best == none:
                    break
                i = scores.index(best)
                made = parts[i] = parts[i] + parts[i + 1]
                del parts[i + 1], scores[i]
                if i:
                    scores[i - 1] = get(parts[i - 1] + made, none)
                if i < len(scores):
                    scores[i] = get(made + parts[i + 1], none)
            return parts
        parts, after, before = list(word), [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (s := score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or len(parts[i]) + len(parts[j]) != len(made) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def _word(self, word: str) -> tuple[bytes, bytes, str]:
        """The ids, the characters that each covers (a byte of a character: 0 but for its last byte), and their text."""
        made = self.older.get(word)
        if made is None:
            parts = self._merge(word)
            ids, covers, surface = [*map(self.ids.get, parts)], [*map(len, parts)], None
            if None in ids:
                ids, covers = self._fall_back(parts)
                surface = self._surface(ids)
            made = array("i", ids).tobytes(), array("i", covers).tobytes(), word.replace(SPACE, " ") if surface is None else surface
        if len(word) <= 40:
            if len(self.known) >= MEMORY_WORDS // 2:
                self.older = self.known.copy()
                self.known.clear()
            self.known[word] = made
        return made

    def _fall_back(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Characters without a piece as bytes, or as the unknown piece."""
        ids, covers = [], []
        for part in parts:
            found = self.ids.get(part)
            if found is not None:
                ids.append(found)
                covers.append(len(part))
            elif self.byte_ids:
                raw = part.encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in raw]
                covers += [0] * (len(raw) - 1) + [1]
            else:
                ids.append(self.unknown)
                covers.append(len(part))
        return ids, covers

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, str, np.ndarray | None]:
        """Ids, the characters each covers, their joint surface with word marks as spaces, and the alignment."""
        normal, origin = self.normalize(text or "")
        known, word = self.known, self._word
        found = [known.get(w) or word(w) for w in self.words.findall(normal)]
        ids, covers = (np.frombuffer(b"".join(map(itemgetter(i), found)), np.int32) for i in (0, 1))
        return ids, covers, "".join(map(itemgetter(2), found)), origin

    def spans(self, text: str, covers: np.ndarray, origin: np.ndarray | None) -> np.ndarray:
        """The source byte at which each piece ends; a piece begins where the one before ends, the first at 0."""
        stops = np.cumsum(covers)
        if origin is None:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            origin = np.concatenate(([0] * (1 + self.prefix), np.cumsum(width)))
        return origin[stops].astype(np.int64)

    def _surface(self, ids: list[int]) -> str:
        """The text of pieces, word marks as spaces; bytes that make no character give U+FFFD."""
        if not self.special.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw = bytearray()
            if i not in self.hidden:
                out.append(self.unknown_surface if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_characters(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.strip(self._surface(ids))

    def strip(self, surface: str) -> str:
        """Without the word mark that encoding put in front."""
        if self.squeeze:
            return surface.lstrip(" ")
        return surface[1:] if self.prefix and surface[:1] == " " else surface


def _characters(raw: bytes) -> str:
    """UTF-8 with a U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """Read once for each Python worker."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: id, ids (no begin or end ids), decoded text and, with ``spans``, ends.

    ``ends`` has for each piece the byte of the source text (UTF-8) at which it ends; it begins where the piece
    before ends. Of a character's bytes by fallback, the last has the character's span. The word mark put in front
    has no bytes. ``model`` is the path of a SentencePiece BPE model, readable on every executor. A null text is
    empty: no ids, an empty decoded text. Null and repeated ids come back as they are; other columns are not read.
    Whole texts are encoded, however long. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        claim("pieces", made.forget)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids, ends, texts = [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    found, covers, surface, origin = made.encode(text)
                    ids.append(found)
                    texts.append(made.strip(surface))
                    if spans:
                        ends.append(made.spans(text, covers, origin) if len(found) else np.empty(0, np.int64))
                columns = [part.column(0), _lists(ids, np.int32), pa.array(texts, pa.string())]
                names = ["id", "ids", "decoded"]
                if spans:
                    columns.append(_lists(ends, np.int64))
                    names.append("ends")
                yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, ids array<int>, decoded string" + ", ends array<long>" * spans
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays) if arrays else np.empty(0, kind), pa.from_numpy_dtype(kind)))


def piece_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of ``encode_pieces``: n_tokens, ids_sha256, decoded_sha256 and, of the spans, source_bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("source_bytes")] if "ends" in encoded.columns else []),
    )


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with spans, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")))
