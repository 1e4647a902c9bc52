"""Problem 6: encoding of whole texts with a public tokenizer, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftgrid.llm import bpe

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ROWS = 512


@lru_cache(maxsize=4)
def _load(path: str) -> tuple[bytes, int]:
    data = Path(path).read_bytes()
    return data, bpe.sufficient_lookahead(bpe.read_ranks(data))


def _shared(df: DataFrame, path: str):
    """The rank file's content (under a megabyte, whatever the data) and its lookahead, sent to the executors once."""
    return df.sparkSession.sparkContext.broadcast(_load(path))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few hundred rows at a time, so that what long texts become does not pile up; the session's settings stay as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _packed(vocabulary: bpe.Vocabulary, text: str | None, hold: int = 1 << 16) -> bytes:
    if not text:
        return b""
    if len(text) <= hold:
        return vocabulary.encode(text)
    encoder = bpe.Encoder(vocabulary, hold)
    return b"".join([*(encoder.feed(text[at : at + hold]) for at in range(0, len(text), hold)), encoder.finish()])


def encode_ids(rows: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the token ids of each row's whole text, without special tokens, one row for each row.

    Null and empty texts give an empty list; strings of special tokens are ordinary text. No shuffle.
    """
    shared, kind = _shared(rows, path), rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(*shared.value)
        for batch in _slices(batches):
            packed = [_packed(vocabulary, x) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(rows: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id_col, tokens BIGINT): the number of ids that ``encode_ids`` gives, without moving them."""
    shared, kind = _shared(rows, path), rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(*shared.value)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(_packed(vocabulary, x)) // 4 for x in batch.column(1).to_pylist()], pa.int64())], [id_col, "tokens"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")


def decode_ids(rows: DataFrame, id_col: str, ids_col: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """(id_col, text): the text of each list of ids, by the incremental decoder; null lists give null."""
    shared, kind = _shared(rows, path), rows.schema[id_col].dataType.simpleString()

    def one(vocabulary: bpe.Vocabulary, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        decoder = bpe.Decoder(vocabulary)
        return "".join([*(decoder.feed(ids[at : at + 4096]) for at in range(0, len(ids), 4096)), decoder.finish()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(*shared.value)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(vocabulary, x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
