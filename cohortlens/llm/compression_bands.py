"""Quality rule by compression bands (zstandard ratio limits by length).

A text's ratio is raw bytes / compressed bytes.  Repetitive text compresses too
well, noise too badly; both depend on length, so each length band has its own
limits.  The whole text is judged by ``WHOLE_BANDS``; texts of more than one
chunk are also judged chunk by chunk (``CHUNK_BYTES`` each), and fail if chunks
outside ``CHUNK_LIMITS`` hold more than ``MAX_BAD_PERCENT`` of the bytes judged.

Narrow: one pass, no shuffle, memory bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import give_back, ship_package
from cohortlens.llm.words import Words, text_chunks

#: (bytes below which the band holds, least ratio, greatest ratio); None: no limit
WHOLE_BANDS: tuple[tuple[float, float | None, float | None], ...] = (
    (128, None, None),        # frame overhead dominates: not judged
    (256, 0.95, 2.5),
    (1024, 1.1, 3.0),
    (4096, 1.25, 4.0),
    (32768, 1.4, 5.0),
    (float("inf"), 1.5, 6.5),
)
CHUNK_BYTES = 4096
CHUNK_LIMITS = (1.25, 4.0)
MAX_BAD_PERCENT = 30
LEVEL = 3
#: bytes of texts whose base counts are made at once
TEXT_BYTES = 1 << 19
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WORDS = 20, 30, 8

FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_bytes bigint, whole_ratio double, bad_chunk_bytes bigint, "
          "judged_chunk_bytes bigint, reason string")
_TYPE = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                   ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                   ("kept", pa.bool_()), ("n_bytes", pa.int64()), ("whole_ratio", pa.float64()),
                   ("bad_chunk_bytes", pa.int64()), ("judged_chunk_bytes", pa.int64()), ("reason", pa.string())])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\r\x0b\x0c"


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.strip(_BLANK))
        else:
            seen.add(line)
    return n


def base_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The five base counts of each text."""
    w = Words(texts)
    lead = ((w.buf & 0xC0) != 0x80).astype(np.int64)
    lead_sum = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(lead, out=lead_sum[1:])
    sym = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_SYMBOL[w.buf], out=sym[1:])
    where, h = w.grams(REPEAT_WORDS)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(where):
        row = w.row()[where].astype(np.uint64)
        twice = pd.Series(h + row * np.uint64(0xA0761D6478BD642F)).duplicated(keep=False).to_numpy()
        covered[where[twice]] += 1
        np.subtract.at(covered, where[twice] + REPEAT_WORDS, 1)
    return {
        "n_words": w.count,
        "word_chars": w.per_row(lead_sum[w.end] - lead_sum[w.start]),
        "n_symbols": sym[w.at[1:]] - sym[w.at[:-1]],
        "n_dup_lines": np.fromiter((_dup_lines(t) if t else 0 for t in texts), np.int64, len(texts)),
        "n_repeat_words": w.per_row(np.cumsum(covered)[:-1] > 0),
    }


def band_verdict(text: bytes, compress, bands: Sequence = WHOLE_BANDS, chunk_bytes: int = CHUNK_BYTES,
                 chunk_limits: tuple[float, float] = CHUNK_LIMITS,
                 max_bad_percent: float = MAX_BAD_PERCENT) -> tuple[float | None, int, int, str | None]:
    """(whole ratio, bytes of chunks outside the limits, bytes of chunks judged, reason to reject or None)."""
    n = len(text)
    if not n:
        return None, 0, 0, None
    ratio = n / len(compress(text))
    low, high = next((lo, hi) for below, lo, hi in bands if n < below)
    reason = "repetitive" if high is not None and ratio > high else \
        "incompressible" if low is not None and ratio < low else None
    bad = judged = 0
    if n > chunk_bytes:
        for at in range(0, n, chunk_bytes):
            part = text[at:at + chunk_bytes]
            if 2 * len(part) < chunk_bytes:  # a short rest is not comparable
                continue
            r = len(part) / len(compress(part))
            judged += len(part)
            bad += len(part) * (not chunk_limits[0] <= r <= chunk_limits[1])
        if reason is None and 100 * bad > max_bad_percent * judged:
            reason = "chunks"
    return ratio, bad, judged, reason


def compression_bands(text: Column, bands: Sequence = WHOLE_BANDS, chunk_bytes: int = CHUNK_BYTES,
                      chunk_limits: tuple[float, float] = CHUNK_LIMITS,
                      max_bad_percent: float = MAX_BAD_PERCENT, level: int = LEVEL) -> Column:
    """Struct column (``FIELDS``) with base counts, ratios and the verdict ``kept`` of a text column.

    Null and empty texts: all counts 0, ``base_failed`` true, ``whole_ratio`` null.
    Equal texts get equal results; other columns play no part.
    """
    ship_package()

    @F.arrow_udf(FIELDS)
    def judge(col: pa.Array) -> pa.Array:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        out: list[dict] = []
        for _, texts in text_chunks(col, TEXT_BYTES):
            counts = {k: v.tolist() for k, v in base_counts(texts).items()}
            for i, t in enumerate(texts):
                row = {k: v[i] for k, v in counts.items()}
                ratio, bad, judged, reason = band_verdict(t or b"", compress, bands, chunk_bytes, chunk_limits,
                                                          max_bad_percent)
                failed = row["n_words"] < MIN_WORDS or 100 * row["n_repeat_words"] > MAX_REPEAT_PERCENT * row["n_words"]
                row |= {"base_failed": failed, "kept": not failed and reason is None, "n_bytes": len(t or b""),
                        "whole_ratio": ratio, "bad_chunk_bytes": bad, "judged_chunk_bytes": judged,
                        "reason": "base" if failed else reason}
                out.append(row)
        give_back()
        return pa.array(out, _TYPE)

    return judge.asNondeterministic()(text)


def judge_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus a struct column ``quality`` (a column of that name is replaced)."""
    return docs.withColumn("quality", compression_bands(F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the base rule and the bands keep, with the columns of ``docs``."""
    mark = "_quality_of_text"
    while mark in docs.columns:
        mark += "_"
    return docs.withColumn(mark, compression_bands(F.col(text_col))).filter(F.col(mark)["kept"]).select(*docs.columns)
