"""Quality rules: compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. Text that is
repeated compresses far more than prose of its length, random characters hardly
at all; each length has its own band of ratios (bytes before : bytes after)
outside which a text goes. Two bands hold at once: fixed limits for any corpus,
and limits measured on this one, WIDTH spreads to either side of the median of
all texts of about that length that pass the base rules. The spread is the
median deviation, so that some odd texts do not widen it. Chunks, the last and
shorter one included, catch a long text that is normal on average but repetitive
or random for most of its bytes.

Words, symbols, repeated lines and repeated three-word windows are counted over
the whole text, too, in numpy over word hashes.

Defined results: a null or empty text has no words, so it fails the base rules;
a very long text is compressed whole; a ratio that equals a limit (a tie) is
inside; lengths of which fewer than LEAST_MEASURED texts pass the base rules have
the fixed limits only; rows repeated in full are judged alike, and null or
repeated ids change nothing; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, encoded, grouped_word_hashes, materialise, mix, prepare, sums_by

LEVEL = 3
CHUNK = 4096
#: From so many bytes: lowest and highest ratio of a whole text. Short texts leave the compressor little to find.
BANDS = ((0, 0.0, 5.0), (256, 1.15, 5.0), (1024, 1.35, 5.0), (4096, 1.5, 5.5), (16384, 1.6, 6.0), (65536, 1.6, 7.0))
#: Lowest and highest ratio of a full chunk, and the part of chunks that may lie outside.
CHUNK_BAND = (1.4, 6.0)
CHUNK_SHARE = 0.5
#: Length classes measured, a quarter of a doubling each; spreads from the median; texts that a class needs.
STEPS = 4
WIDTH = 4.0
LEAST_MEASURED = 100
#: The spread of a normal distribution over its median deviation, and the least spread.
NORMAL = 1.4826
LEAST_SPREAD = 0.02
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50


def ratio(raw: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(raw) / len(compressor.compress(raw)) if raw else 0.0


def verdict(raw: bytes, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE) -> tuple[float, float, bool]:
    """Ratio of the whole, part of the bytes in chunks outside their band, and whether the text stays."""
    limits = lambda size: next((a, b) for n, a, b in reversed(bands) if size >= n)
    inside = lambda value, band: band[0] <= value <= band[1]
    whole, outside = ratio(raw, compressor), 0
    for i in range(0, len(raw) if len(raw) > chunk else 0, chunk):
        part = raw[i : i + chunk]
        if not inside(ratio(part, compressor), chunk_band if len(part) == chunk else limits(len(part))):
            outside += len(part)
    outside /= max(1, len(raw))
    return whole, outside, inside(whole, limits(len(raw))) and outside <= chunk_share


def length_class(n_bytes: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_bytes, F.lit(1))) * STEPS).cast("int")


def measured_bands(judged: DataFrame, width: float = WIDTH, least: int = LEAST_MEASURED) -> dict[int, tuple[float, float]]:
    """Limits by length class from all texts that pass the base rules; a class is one row on the driver, a few hundred at most."""
    usual = judged.filter(~F.col("base_failed")).select(length_class(F.col("n_bytes")).alias("class"), "ratio")
    middle = {r["class"]: r["m"] for r in usual.groupBy("class").agg(F.count("*").alias("n"), F.percentile_approx("ratio", 0.5, 10_000).alias("m")).filter(F.col("n") >= least).collect()}
    if not middle:
        return {}
    away = F.abs(F.col("ratio") - _looked_up(middle, F.col("class")))
    spread = usual.groupBy("class").agg(F.percentile_approx(away, 0.5, 10_000).alias("s")).filter(F.col("s").isNotNull()).collect()
    return {r["class"]: (middle[r["class"]] - g, middle[r["class"]] + g) for r in spread for g in [width * max(NORMAL * r["s"], LEAST_SPREAD)]}


def _looked_up(table: dict[int, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv]), key)


def repeated_words(hashes: np.ndarray, per: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in that text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(len(per), dtype=np.int64)
    owner = np.repeat(np.arange(len(per)), per)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    key = mix(key[at] ^ (owner[at].astype(np.uint64) << np.uint64(32)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    often = np.zeros(len(at), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(len(hashes), dtype=bool)
    for k in range(window):
        hit[at[often] + k] = True
    return sums_by(hit.astype(np.int64), per)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE, width: float = WIDTH) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the ratios they rest on; one row per input row.

    The texts are read once; their figures are written, as the measured limits rest on all of them.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        raws = encoded(texts)
        n_words, n_repeat = np.zeros(len(raws), dtype=np.int64), np.zeros(len(raws), dtype=np.int64)
        for i, j, hashes, per in grouped_word_hashes(raws):
            n_words[i:j] = per
            n_repeat[i:j] = repeated_words(hashes, per)
        compressor = zstandard.ZstdCompressor(level=level)
        judged = [verdict(r, compressor, bands, chunk, chunk_band, chunk_share) for r in raws]
        failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
        return {
            "doc_id": batch.column("doc_id"), "n_words": n_words,
            "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [repeated_lines(t) for t in texts],
            "n_repeat_words": n_repeat, "base_failed": failed,
            "n_bytes": [len(r) for r in raws], "ratio": [j[0] for j in judged], "chunks_outside": [j[1] for j in judged], "in_fixed": [j[2] for j in judged],
        }

    judged = materialise(arrow_map(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, chunks_outside double, in_fixed boolean",
    ), "ratios")
    bands_here = measured_bands(judged, width)
    in_measured = F.lit(True)
    if bands_here:
        low, high = (_looked_up({k: v[side] for k, v in bands_here.items()}, length_class(F.col("n_bytes"))) for side in (0, 1))
        in_measured = F.coalesce(F.col("ratio").between(low, high), F.lit(True))
    kept = ~F.col("base_failed") & F.col("in_fixed") & in_measured
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio", "chunks_outside", "n_bytes")
