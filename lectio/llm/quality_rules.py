"""Quality rules: counts over words and lines, and compression bands of whole texts and of chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lectio.llm.common import documents, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
LEVEL = 3
CHUNK = 4096
#: A document with more than this share of chunks outside their band is rejected. Of 1,407 documents of plain prose none has one.
BAD_CHUNKS = 0.1
#: (bytes up to, lowest ratio, highest ratio) of compressed to plain size. Short texts compress worse,
#: so both limits fall with the length. Plain prose lies far inside: 0.5 to 0.9 below 512 bytes, 0.35 to
#: 0.6 from 2 kB on. Text that repeats itself falls below, encoded or random text stands above.
BANDS = ((127, 0.0, 9.0), (255, 0.38, 1.00), (511, 0.34, 0.95), (1023, 0.30, 0.88), (2047, 0.27, 0.78), (8191, 0.24, 0.72), (2**63, 0.20, 0.70))

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(WINDOW)]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included.

    Equal windows have equal sums of hashes; windows whose sum is repeated are compared word by word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k, odd in enumerate(_ODD):
        sums += hashes[k : k + n] * odd
    order = np.sort(sums)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(sums, again)).tolist()
    windows = [b" ".join(words[i : i + WINDOW]) for i in at]
    often = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, w in zip(at, windows, strict=True) if often[w] > 1], np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def in_band(size: int, compressed: int) -> bool:
    low, high = next(band[1:] for band in BANDS if size <= band[0])
    return low <= compressed / size <= high


def chunks_of(data: bytes) -> list[bytes]:
    """Chunks of CHUNK bytes; a last one of less than half of that belongs to the one before. A text of one chunk has none."""
    n = max(1, (len(data) + CHUNK // 2) // CHUNK)
    return [data[i * CHUNK : (i + 1) * CHUNK if i < n - 1 else None] for i in range(n)] if n > 1 else []


def measured(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    """The values of FIELDS for one whole text."""
    data = text.encode()
    words = data.split()  # bytes: the six ASCII white-space characters
    repeats = repeated_words(words)
    duplicates = 0
    if "\n" in text:
        duplicates = sum(n - 1 for line, n in Counter(text.split("\n")).items() if n > 1 and line.strip(SPACES))
    base_failed = len(words) < MIN_WORDS or 100 * repeats > 30 * len(words)
    size = len(compressor.compress(data)) if data else 0
    chunks = chunks_of(data)
    bad = sum(not in_band(len(c), len(compressor.compress(c))) for c in chunks)
    kept = not base_failed and in_band(len(data), size) and bad <= BAD_CHUNKS * len(chunks)
    ratio = size / len(data) if data else 0.0
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeats, base_failed, kept, ratio, len(chunks), bad


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in batches:
        rows = list(zip(*(measured(t, compressor) for t in batch.column(1).to_pylist()), strict=True)) or [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, _TYPES, strict=True))], ["doc_id", *names])


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and FIELDS.

    base_failed: under MIN_WORDS words, or over 30 % of them in repeated windows. kept: not
    base_failed, the whole text's ratio within the band for its length, and at most BAD_CHUNKS of its
    chunks of CHUNK bytes outside theirs (texts of one chunk are judged as a whole). A null text has
    no words and fails. Rows are independent: nothing is shuffled. Extra columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return texts(docs).mapInArrow(_measure_batches, f"doc_id {kind}, {FIELDS}")


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        kept = [measured(t or "", compressor)[6] for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that :func:`quality` keeps, with all their columns, in one pass."""
    return docs.mapInArrow(_kept_batches, docs.schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
