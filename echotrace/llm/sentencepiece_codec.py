"""SentencePiece encoding and decoding over a given model file.

The pieces form an Aho-Corasick automaton.  One pass over a text meets, at every
position, all pieces that end there, longest first along the output links, and relaxes
the best score of that position (Viterbi); the best path's pieces are the encoding.
Scores are those of the model; ties go to the longer last piece.  A character that is
no piece falls back to the pieces of its UTF-8 bytes, or else to the unknown piece.

Spaces become U+2581 and one is put before the text, as the model's normaliser asks.
No piece of such a vocabulary reaches over the start of a run of U+2581 that follows
another character, so a text falls apart into chunks whose best paths are independent;
each worker remembers the paths of recent chunks.  (Where a vocabulary has such a piece,
whole texts are single chunks.)  A literal U+2581 is encoded by its bytes, which keeps
decoding exact.

A model whose normaliser maps characters, drops white space or keeps it as it is, is
refused, as its texts could not be decoded exactly.

Defined results: null text has null ids, an empty text has no ids; decoding an encoding
gives the text back; repeated rows are each encoded; extra columns are kept by
``encode`` and ``decode``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Paths of chunks that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-size values as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + size]
            i += size


class Codec:
    """The automaton of one model; encodes and decodes texts."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.byte: dict[int, int] = {}
        self.unknown, scores, kinds, prefix = 0, [], [], True
        for number, value in fields(model):
            if number == 1:
                part = dict(fields(value))
                self.pieces.append(part[1].decode())
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, NORMAL))
            elif number == 3:
                rules = dict(fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model maps characters or drops white space, which this codec does not do")
        self.prefix = SPACE if prefix else ""
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        apart, worst = True, 0.0
        for i, (piece, score, kind) in enumerate(zip(self.pieces, scores, kinds)):
            if kind == BYTE:
                self.byte[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (NORMAL, USER_DEFINED) and piece:
                self.automaton.add_word(piece, (len(piece), score, i))
                worst = min(worst, score)
                apart &= SPACE not in piece.lstrip(SPACE)
                if len(piece) == 1:
                    self.single.add(piece)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.worst = worst - UNKNOWN_PENALTY
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if apart else re.compile(r"(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}
        plain = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER_DEFINED) else b"" for p, k in zip(self.pieces, kinds)]
        for value, i in self.byte.items():
            plain[i] = bytes([value])
        plain[self.unknown] = " ⁇ ".encode()
        self.plain = pa.array(plain, pa.large_binary())

    def best_path(self, chunk: str) -> tuple[int, ...]:
        n = len(chunk)
        best, back, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        single, worst, done = self.single, self.worst, 0
        for end, (size, score, i) in self.automaton.iter(chunk) if len(self.automaton) else ():
            end += 1
            while done < end - 1:  # no piece ends here any more
                done += 1
                if chunk[done - 1] not in single and best[done - 1] + worst > best[done]:
                    best[done], back[done], piece[done] = best[done - 1] + worst, done - 1, -1
            score += best[end - size]
            if score > best[end]:
                best[end], back[end], piece[end] = score, end - size, i
        while done < n:
            done += 1
            if chunk[done - 1] not in single and best[done - 1] + worst > best[done]:
                best[done], back[done], piece[done] = best[done - 1] + worst, done - 1, -1
        path = []
        while n:
            path += [piece[n]] if piece[n] >= 0 else self.bytes_of(chunk[n - 1])[::-1]
            n = back[n]
        return tuple(path[::-1])

    def bytes_of(self, char: str) -> list[int]:
        raw = char.encode()
        return [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]

    def encode(self, text: str) -> list[int]:
        """The ids of the best path over the text."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for k, part in enumerate(text.split(SPACE) if SPACE in text else (text,)):
            if k:
                out += self.bytes_of(SPACE)
            for chunk in self.chunk.findall((part if k else self.prefix + part).replace(" ", SPACE)):
                path = known.get(chunk)
                if path is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    path = self.best_path(chunk)
                    if len(chunk) <= 64:
                        known[chunk] = path
                out += path
        return out

    def decode_lists(self, ids: pa.LargeListArray) -> pa.Array:
        """The texts of lists of ids; null for null."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, self.plain.take(ids.values)), pa.scalar(b"", pa.large_binary()))
        gap = len(self.prefix)
        out = [None if not ok else raw[gap:].decode(errors="replace") if raw[:gap] == b" "[:gap] else raw.decode(errors="replace") for ok, raw in zip(ids.is_valid().to_pylist(), joined.to_pylist())]
        return pa.array(out, pa.large_string())


_codecs: dict[int, Codec] = {}


def _codec(held) -> Codec:
    model = held.value
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _lists(codec: Codec, texts: list[str | None]) -> pa.LargeListArray:
    """Ids of the texts, kept as arrays from one text to the next."""
    parts = [np.array(codec.encode(t), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)), mask=pa.array([t is None for t in texts]) if texts else None)


def _slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, min(hi, len(sizes))
        lo = hi


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens added; check also decodes and adds round_trip. Columns of those names are replaced."""
    docs = docs.drop("ids", "n_tokens", "round_trip")
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * check])

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            for lo, hi in _slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                ids = _lists(codec, texts)
                added = [ids.cast(pa.list_(pa.int32())), pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())]
                if check:
                    added.append(pa.array([None if a is None else a == b for a, b in zip(texts, codec.decode_lists(ids).to_pylist())], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), *added], [f.name for f in schema])

    return docs.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded, with the texts of its ids added as decoded (a column of that name is replaced)."""
    encoded = encoded.drop("decoded")
    held = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            ids = batch.column("ids").cast(pa.large_list(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode_lists(ids).cast(pa.string())], [f.name for f in schema])

    return encoded.mapInArrow(lean(run), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_tokens", "ids", F.coalesce("round_trip", F.lit(True)).alias("round_trip"))
