"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

The vocabulary is serialised as a sentencepiece BPE model: one piece per token, its bytes mapped to printable characters, its
score the negative rank, and identity normalisation. sentencepiece then merges, at each step, the neighbours whose union has
the lowest rank, which is what byte-level BPE does. A text is split into pre-tokens by the vocabulary's pattern; each distinct
pre-token of a task is encoded once and remembered (up to a fixed number). Decoding maps ids to bytes again.

Null and empty texts give the empty list; blank texts are encoded as they stand; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.arrays import CACHE

DEFAULT_FOLDER = "/opt/tokenizers"
#: The split pattern of the byte_bpe vocabularies (a fixed value of that format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model of a vocabulary; the id of a piece is its rank and the unknown piece comes last."""
    chars = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        score = np.float32(-rank).tobytes()
        pieces.append(_bytes(1, _bytes(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + score + _number(3, 1)))
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _number(3, 2)))
    # Trainer: BPE, vocabulary size, no begin, end or padding pieces. Normaliser: identity without any change of blanks.
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    """Encodes and decodes with one vocabulary; made once in each Python worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.tokens = read_vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if ("encoder", path) not in CACHE:
            CACHE["encoder", path] = cls(path)
        return CACHE["encoder", path]

    def encode_all(self, texts: list) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = list({p for ps in parts for p in ps if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for ps in parts for p in ps})
        # bytes -> Latin-1 characters -> printable characters, as one C-level translation
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for p in new]
        known.update(zip(new, self.model.encode(mapped, num_threads=1)))
        return [[i for p in ps for i in known[p]] for ps in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    """Where a vocabulary lies: in folder, or in the installed package of public tokenizers."""
    import os

    path = os.path.join(folder, f"{name}.tiktoken")
    return path if os.path.exists(path) else importlib.import_module("public_tokenizers").path(f"{name}.tiktoken")


def encode_corpus(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, batch: int = 500) -> DataFrame:
    """id, ids: the token ids of each row's text; a narrow map without any shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, 1, name, folder, batch):
            ends = np.cumsum([0] + [len(x) for x in ids])
            flat = pa.array(np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>")


def _encoded(batches: Iterator[pa.RecordBatch], column: int, name: str, folder: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Parts of the batches with the ids of a column of texts."""
    encoder = Encoder.of(vocabulary_path(name, folder))
    for whole in batches:
        for begin in range(0, whole.num_rows, size):
            part = whole.slice(begin, size)
            yield part, encoder.encode_all(part.column(column).to_pylist())


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """id, text: the inverse of encode_corpus; null or empty ids give the empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary_path(name, folder))
        for part in batches:
            texts = [encoder.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string")


def token_report(df: DataFrame, text_col: str, group_col: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, batch: int = 500) -> DataFrame:
    """Records, characters and tokens of each group, in one pass over the rows; repeated rows count each."""
    kind = df.schema[group_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, 2, name, folder, batch):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int32())], ["group", "chars", "tokens"])

    rows = df.select(group_col, F.coalesce(F.length(text_col), F.lit(0)), text_col).mapInArrow(run, f"group {kind}, chars int, tokens int")
    return rows.groupBy("group").agg(F.count("*").alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
