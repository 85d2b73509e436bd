"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quern.llm import ragged
from quern.llm.shared import map_arrow, need, table

LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes, least ratio, greatest ratio); between two lengths the limits run straight in log2(bytes).
#: Natural prose packs better the longer it is, so both limits rise; no least ratio binds below 256 bytes,
#: where the frame's own header weighs.
BANDS = ((64, 0.0, 1.75), (128, 0.0, 2.0), (256, 0.9, 2.25), (512, 1.1, 2.4), (1024, 1.25, 2.6), (2048, 1.35, 2.75), (4096, 1.45, 2.9), (16384, 1.55, 3.2), (1 << 20, 1.6, 3.6))
#: A document whose whole is in its band goes if at least this share of its chunks is outside theirs.
CHUNK_SHARE = 0.5
SCHEMA = "doc_id long, n_bytes long, ratio double, n_chunks long, n_repetitive long, n_incompressible long, kept boolean, reason string"


def limits(n_bytes: np.ndarray, bands=BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ratio for texts of these lengths."""
    x = np.log2(np.maximum(n_bytes, 1))
    at = [math.log2(b[0]) for b in bands]
    return np.interp(x, at, [b[1] for b in bands]), np.interp(x, at, [b[2] for b in bands])


def measure(text: bytes, compressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, list[tuple[int, float]]]:
    """The ratio of a text and (length, ratio) of its chunks; a text of one chunk has no others."""
    whole = len(text) / len(compressor.compress(text))
    if len(text) <= chunk_bytes:
        return whole, [(len(text), whole)]
    return whole, [(len(c), len(c) / len(compressor.compress(c))) for c in (text[i : i + chunk_bytes] for i in range(0, len(text), chunk_bytes))]


def judge(col: pa.Array, compressor, chunk_bytes: int, chunk_share: float, bands) -> tuple[np.ndarray, ...]:
    """Of each text: bytes, ratio, chunks, chunks above and below their bands, and why it is rejected, if it is."""
    n, off = len(col), ragged.offsets(col)
    data = memoryview(col.buffers()[2] or b"")
    size, ratio, chunks = np.diff(off), np.full(n, np.nan), []
    for i in range(n):
        if size[i]:
            ratio[i], parts = measure(data[off[i] : off[i + 1]], compressor, chunk_bytes)
            chunks += [(i, *p) for p in parts]
    own, c_size, c_ratio = (np.array(x) for x in zip(*chunks)) if chunks else (np.empty(0, np.int64), np.empty(0), np.empty(0))
    lo, hi = limits(c_size, bands)
    count = lambda hit: np.bincount(own[hit].astype(np.int64), minlength=n)
    n_chunks, above, below = count(np.ones(own.size, bool)), count(c_ratio > hi), count(c_ratio < lo)
    lo, hi = limits(size, bands)
    most = np.maximum(chunk_share * n_chunks, 1)
    reason = np.select([size == 0, (ratio > hi) | (above >= most), (ratio < lo) | (below >= most)], ["empty", "repetitive", "incompressible"], "")
    return size, ratio, n_chunks, above, below, reason


def compression_bands(docs: DataFrame, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, bands=BANDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A verdict for each document from its zstandard ratios.

    A document is rejected if the ratio of its whole text is outside the band for its length, or if
    `chunk_share` of its chunks of `chunk_bytes` bytes are outside the bands for theirs: above is
    'repetitive', below is 'incompressible'.  One pass, no shuffle, every byte is compressed.  A null or
    empty text is rejected as 'empty' with a null ratio; a null key and repeated rows are kept as they
    are; an empty table gives an empty result; other columns are ignored.
    """

    def work(it):
        z = zstandard.ZstdCompressor(level=level)
        for batch, col in ragged.batches(it, "text"):
            size, ratio, n_chunks, above, below, reason = judge(col, z, chunk_bytes, chunk_share, bands)
            kept = reason == ""
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size), pa.array(ratio, mask=size == 0), pa.array(n_chunks), pa.array(above), pa.array(below), pa.array(kept), pa.array(reason.astype(object), pa.string(), mask=kept)],
                names=["doc_id", "n_bytes", "ratio", "n_chunks", "n_repetitive", "n_incompressible", "kept", "reason"],
            )

    return map_arrow(need(docs, key, text).toDF("doc_id", "text"), work, SCHEMA)


def within_bands(docs: DataFrame, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, bands=BANDS, text: str = "text") -> DataFrame:
    """The rows that `compression_bands` keeps, with all their columns, in the same single pass.

    Null and empty texts go; a text of blanks is judged like others; null keys and further columns, whatever their
    names, are passed on; ties don't arise and repeated rows are judged alike; an empty table gives an empty one.
    """

    def work(it):
        z = zstandard.ZstdCompressor(level=level)
        for batch, col in ragged.batches(it, text):
            yield batch.filter(pa.array(judge(col, z, chunk_bytes, chunk_share, bands)[-1] == ""))

    return map_arrow(docs, work, docs.schema)


def op7_compression_bands(spark, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


QUERIES = {"op7_compression_bands": op7_compression_bands}
ORACLE_SQL: dict[str, str] = {}
