"""Packing of token ids into sequences of a fixed length, with bounded space per partition."""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm import merges
from lectio.llm.common import documents, texts, written

LENGTH = 2048
OPEN_WINDOWS = 64
#: An emitted window with a larger gap is filled by cutting the document at hand.
GAP = 8
END_ID = 1
#: The six ASCII white-space characters become a space.
SPACES = bytes(0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
#: Leftover windows of so many partitions are merged by one task: FAN_IN * LENGTH ids at most.
FAN_IN = 256

PIECES = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# ---------------------------------------------------------------- tokens


class Letters:
    """What the tokenizer does with single characters, as tables over code points below LIMIT.

    kind: letter, digit, other, or UNSURE where normalisation, case or the age of the character is
    not plain; lower: the lower-case character. A word with an UNSURE character goes to the library.
    """

    UNSURE, LETTER, DIGIT, OTHER = range(4)
    LIMIT = 0xD800

    def __init__(self):
        old = unicodedata.ucd_3_2_0
        self.kind = np.zeros(self.LIMIT, np.uint8)
        self.lower = np.arange(self.LIMIT, dtype=np.uint32)
        for point in range(0x21, self.LIMIT):
            c = chr(point)
            category, low = old.category(c), c.lower()
            settled = category == unicodedata.category(c) and category not in ("Cn", "Cc", "Zs", "Zl", "Zp") and not c.isspace()
            if settled and len(low) == 1 and not unicodedata.combining(c) and c not in "'Σσς" and not 0x1100 <= point < 0x1200:
                if unicodedata.is_normalized("NFC", c) and category[0] != "M":
                    self.kind[point] = self.LETTER if category[0] == "L" else self.DIGIT if category[0] == "N" else self.OTHER
                    self.lower[point] = ord(low)


class WordTokenizer:
    """Ids of a tokenizer that drops white space, found word by word.

    Its words never reach across ASCII white space (normaliser and splitter treat what stands between
    independently), so a text's ids are those of its white-space separated chunks in order. The
    distinct chunks of a slice of texts are found once; runs of letters, single digits and runs of
    other characters are merged by :func:`merges.merge`, chunks with anything else by the library.
    Nothing is kept from one slice to the next.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.pairs = merges.PairTable(left, right, np.arange(len(pairs), dtype=np.int32), made)
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.first = np.array([vocabulary[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[names[b] + suffix] for b in range(256)], np.int32)
        self.letters = Letters()

    def encode(self, values: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        words = [len(x.split(None, 1)) > 0 for x in values]
        some = [x for x, there in zip(values, words, strict=True) if there]
        found = iter(self._encode(some) if some else [])
        return [next(found) if there else b"" for there in words]

    def _encode(self, values: list[bytes]) -> list[bytes]:
        data = np.frombuffer((b" " + b" ".join(values)).translate(SPACES), np.uint8)
        begins = np.cumsum([0, *(len(x) + 1 for x in values[:-1])])
        space = data == 0x20
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        edges = np.append(np.searchsorted(starts, begins), len(starts))
        keep = ~space
        keep[starts] = True
        if not keep.all():
            data = data[keep]
            starts = np.flatnonzero(data == 0x20)
        places, chunks, offsets = merges.distinct(data, starts)
        ids, counts = self._ids(chunks, len(offsets) - 1)
        flat, at = merges.joined(merges.ragged(ids.astype("<u4"), counts).take(pa.array(places)))
        cuts = at[edges].tolist()
        return [bytes(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids(self, chunks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` distinct chunks, each a space and a word, and their number per chunk."""
        text = chunks.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        small = np.minimum(points, Letters.LIMIT - 1)
        space = points == 0x20
        kind = np.where(points < Letters.LIMIT, self.letters.kind[small], Letters.UNSURE)
        word = np.cumsum(space, dtype=np.int32) - 1
        unsure = (kind == Letters.UNSURE) & ~space
        unsure[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))  # may begin a special token
        library = np.zeros(n, bool)
        library[word[unsure]] = True
        first = np.ones(len(points), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == Letters.DIGIT) | space[:-1]
        width = 1 + (points >= 0x80) + (points >= 0x800)
        width[space] = 0
        part = np.cumsum(first & ~space, dtype=np.int32) - 1
        sizes = np.bincount(part[~space], width[~space])
        library[word[~space][sizes[part[~space]] > merges.LONGEST]] = True
        own = ~space & ~library[word]
        first, owner = first[own], word[own]
        data = np.frombuffer(self.letters.lower[small[own]].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ends = np.cumsum(np.select([self.letters.lower[small[own]] < 0x80, self.letters.lower[small[own]] < 0x800], [1, 2], 3))
        symbols = self.first[data]
        heads = np.flatnonzero(first)
        tails = ends[np.append(heads[1:], len(first)) - 1] if len(heads) else heads
        symbols[tails - 1] = self.last[data[tails - 1]]
        merged, parts = merges.merge(symbols, np.diff(tails, prepend=0), self.pairs)
        counts = np.bincount(owner[heads], parts, n).astype(np.int64) if len(heads) else np.zeros(n, np.int64)
        others = np.flatnonzero(library)
        if not len(others):
            return merged, counts
        edges = np.append(np.flatnonzero(space), len(points))
        encoded = self.tokenizer.encode_batch_fast([text[edges[k] + 1 : edges[k + 1]] for k in others], add_special_tokens=False)
        listed = [e.ids for e in encoded]
        counts[others] = list(map(len, listed))
        out = np.empty(counts.sum(), np.uint32)
        foreign = np.repeat(library, counts)
        out[foreign] = [i for ids in listed for i in ids]
        out[~foreign] = merged
        return out, counts


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and path, kept between tasks."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# ---------------------------------------------------------------- windows

#: doc_id, start, ids (little-endian uint32), tokens of the document
Piece = tuple[object, int, bytes, int]


class Packer:
    """A fixed number of open windows; a piece goes where it leaves least room.

    Documents are cut at multiples of the window's length; their tails are placed best-fit. Where a
    tail fits nowhere the fullest window is emitted, its gap filled from the tail if it is larger
    than GAP. ``emit`` gets the pieces of each full window.
    """

    def __init__(self, emit, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.emit, self.length, self.windows = emit, length, windows
        self.open: list[tuple[int, int]] = []  # (room, key), ascending
        self.held: dict[int, list[Piece]] = {}
        self.next = 0

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        size, view = 4 * self.length, memoryview(ids)  # a slice of a view copies nothing
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self.emit([(doc, start + at // 4, bytes(view[at : at + size]), total)])
        if whole < len(ids):
            self.place((doc, start + whole // 4, bytes(view[whole:]), total))

    def place(self, piece: Piece) -> None:
        need = len(piece[2]) // 4
        at = bisect_left(self.open, (need, -1))
        if at < len(self.open):
            room, key = self.open.pop(at)
            self.fill(room, key, piece)
        elif len(self.open) < self.windows:
            self.next += 1
            self.held[self.next] = []
            self.fill(self.length, self.next, piece)
        else:
            room, key = self.open.pop(0)
            if room > GAP:
                doc, start, ids, total = piece
                self.held[key].append((doc, start, ids[: 4 * room], total))
                piece = (doc, start + room, ids[4 * room :], total)
            self.emit(self.held.pop(key))
            self.place(piece)

    def fill(self, room: int, key: int, piece: Piece) -> None:
        self.held[key].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.open, (room, key))
        else:
            self.emit(self.held.pop(key))

    def drain(self) -> list[Piece]:
        """Join the open windows' pieces, cutting where a window is full; return what is left of the last."""
        window: list[Piece] = []
        room = self.length
        for _, key in self.open:
            for doc, start, ids, total in self.held[key]:
                at, view = 0, memoryview(ids)
                while len(ids) - at >= 4 * room:
                    self.emit([*window, (doc, start + at // 4, bytes(view[at : at + 4 * room]), total)])
                    at, window, room = at + 4 * room, [], self.length
                if at < len(ids):
                    window.append((doc, start + at // 4, bytes(view[at:]), total))
                    room -= (len(ids) - at) // 4
        self.open, self.held = [], {}
        return window


class _Rows:
    """Collects pieces as record batches; sequences count up from a task's first id."""

    def __init__(self, schema: pa.Schema, first: int):
        self.schema, self.sequence, self.rows = schema, first, []

    def emit(self, pieces: list[Piece], sequence: int | None = None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.sequence if sequence is None else sequence, offset))
            offset += len(ids) // 4
        self.sequence += sequence is None

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def _schema(doc_type: pa.DataType) -> pa.Schema:
    n = pa.int64()
    return pa.schema([("doc_id", doc_type), ("start", n), ("length", n), ("ids", pa.binary()), ("doc_tokens", n), ("sequence_id", n), ("offset", n)])


def _pack_partition(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        rows = packer = None
        for batch in batches:
            if packer is None:
                rows = _Rows(_schema(batch.schema.field(0).type), part << 33)
                packer = Packer(rows.emit)
            for low, high in merges.slices(pc.binary_length(batch.column(1)).to_pylist()):
                some = batch.slice(low, high - low)
                ids = tokenizer.encode(some.column(1).cast(pa.binary()).to_pylist())
                for doc, x in zip(some.column(0).to_pylist(), ids, strict=True):
                    packer.add((doc, 0, x + end, len(x) // 4 + 1))
                yield rows.flush()
        if packer is not None:
            left = packer.drain()
            rows.emit(left, -1 - part)  # negative: this partition's leftover
            yield rows.flush()

    return run


def _merge_leftovers(level: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(_schema(table.schema.field("doc_id").type), 0)
        table = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        part = -1 - table.column("sequence_id")[0].as_py()
        group = part // FAN_IN**level
        rows.sequence = (1 << 62) + (level << 56) + (group << 16)
        packer = Packer(rows.emit, windows=1 << 30)
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        for k, piece in enumerate(zip(*columns, strict=True)):
            packer.held[k] = [piece]
            packer.open.append((0, k))
        rows.emit(packer.drain(), -1 - part)
        return pa.Table.from_batches([rows.flush()])

    return run


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pack whole documents into sequences of at most LENGTH ids.

    Returns one row per piece: doc_id, start (the document's ids before it), length, ids
    (little-endian uint32), doc_tokens (the closing id counted), sequence_id, offset. A null or empty
    text is the closing id alone. A partition keeps OPEN_WINDOWS windows (see :class:`Packer`) and
    closes with at most one that isn't full; those are merged FAN_IN at a time, round by round, and
    the last one of all is the only sequence besides those within GAP of full that needs padding.
    Rows that repeat a doc_id are documents of their own. Extra columns are ignored. No key is
    shuffled, so hot sources don't matter; a task that runs again writes the same ids again.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = PIECES.format(kind=kind)
    done = written(texts(docs).mapInArrow(_pack_partition(tokenizer_path), schema), "packed")
    whole = done.where("sequence_id >= 0")
    left = done.where("sequence_id < 0")
    parts = left.select(F.max(-F.col("sequence_id"))).first()[0] or 0
    level = 1
    while parts > 1:
        group = F.floor((-1 - F.col("sequence_id")) / FAN_IN**level)
        merged = written(left.groupBy(group.alias("group")).applyInArrow(_merge_leftovers(level), schema), "packed-left")
        whole = whole.unionByName(merged.where("sequence_id >= 0"))
        left = merged.where("sequence_id < 0")
        parts = -(-parts // FAN_IN)
        level += 1
    last = left.withColumn("sequence_id", F.lit((1 << 62) + (1 << 61)))
    return whole.unionByName(last)


def op4_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
