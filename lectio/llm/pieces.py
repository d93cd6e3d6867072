"""Offset-preserving subword encoding: normalise with alignment, cut into pieces, project to source bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectio.llm import merges
from lectio.llm.common import documents, texts

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Types of vocabulary entries, and the kind of model that merges pairs: fixed values of the model's file format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


class CharacterMap:
    """The compiled character map of a model: a double-array trie from source bytes to replacements.

    File format: size of the trie in bytes (little-endian uint32), its units (uint32), then the
    replacements, each ended by a zero byte. A unit holds a label (bits 0-7 and 31), the flag that a
    leaf follows (8), the offset's scale (9) and the offset (10-30); a leaf holds a value (0-30).
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]
        self.seen: dict[int, bytes] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, value) of the longest key that ``data`` has at ``at``; (0, 0) if none."""
        best = (0, 0)
        if not self.units:
            return best
        node = self._offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                best = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, value: int) -> bytes:
        if value not in self.seen:
            self.seen[value] = self.replacements[value : self.replacements.index(b"\0", value)]
        return self.seen[value]


class Normaliser:
    """Source text to normalised text, with the source byte that each normalised byte comes from."""

    def __init__(self, spec, as_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape, self.as_suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, as_suffix
        self.space = SPACE_BYTES if self.escape else b" "
        self.plain = not self.map.units and not self.squeeze and self.escape and not as_suffix

    def __call__(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """Also the alignment: one entry per normalised byte and one for the end."""
        data = text.encode()
        if self.plain:
            source = np.frombuffer(data, np.uint8)
            repeats = np.where(source == 0x20, len(SPACE_BYTES), 1)
            head = np.zeros(len(SPACE_BYTES) if self.dummy and data else 0, np.int64)
            return self(text), np.concatenate([head, np.repeat(np.arange(len(data)), repeats), [len(data)]])
        out, align, at = bytearray(), [], 0

        def step(at: int) -> tuple[bytes, int]:
            matched, value = self.map.longest(data, at)
            if matched:
                return self.map.replacement(value), matched
            length = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return data[at : at + length], length

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.squeeze:
            while at < len(data) and step(at)[0] == b" ":
                at += step(at)[1]
        if at == len(data):
            return "", np.array([at])
        if self.dummy and not self.as_suffix:
            put(self.space, at)
        after_space = self.squeeze
        while at < len(data):
            piece, length = step(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", self.space), at)
                after_space = piece.endswith(b" ")
            after_space = after_space and self.squeeze
            at += length
        while self.squeeze and out.endswith(self.space):
            at = align[len(out) - len(self.space)]
            del out[len(out) - len(self.space) :], align[len(align) - len(self.space) :]
        if self.dummy and self.as_suffix:
            put(self.space, at)
        return out.decode(), np.array([*align, at])


class Encoded(NamedTuple):
    """Per text: little-endian int32 ids, the text that they stand for, bytes of each piece in the marked text."""

    ids: list[np.ndarray]
    decoded: list[bytes]
    lengths: list[np.ndarray]
    decimals: list[bytes]


class PieceEncoder:
    """Ids, source spans and the text that ids stand for.

    Merges run on marked text: normalised text with a space in place of each space mark. Where no
    vocabulary entry has a mark after another character, no piece reaches over the start of a run of
    marks, so a slice of texts is cut there and each distinct chunk is encoded once. Characters that
    no entry holds are their bytes' entries; they never merge. Models of other kinds, chunks of over
    merges.LONGEST mergeable symbols in a row, and unknown characters of models without bytes are
    left to the library. Nothing is kept from one slice to the next.
    """

    def __init__(self, path: str):
        self._load(Path(path).read_bytes())

    @classmethod
    def of_bytes(cls, model: bytes) -> PieceEncoder:
        new = cls.__new__(cls)
        new._load(model)
        return new

    def _load(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = type(proto.normalizer_spec)()
        spec.CopyFrom(proto.normalizer_spec)
        self.normalise = Normaliser(spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.cuts = not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces) and not proto.trainer_spec.treat_whitespace_as_suffix
        self.bytes_of = [b"" if p.type == CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.encode() for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), -1)
        self.unknown_text = proto.trainer_spec.unk_surface or " ⁇ "
        plain = self.unknown_text.encode()
        shown = [plain if i == self.unknown else x.replace(SPACE_BYTES, b" ") for i, x in enumerate(self.bytes_of)]
        self.shown = pa.array(shown, pa.large_binary())
        self.shown_size = np.array(list(map(len, shown)), "<i4")
        self.decimals = pa.array([b"%d," % i for i in range(len(shown))], pa.large_binary())
        self._pairs(proto)
        plain = proto.normalizer_spec  # the processor gets text that is normalised already
        plain.Clear()
        plain.name, plain.add_dummy_prefix, plain.remove_extra_whitespaces, plain.escape_whitespaces = "identity", False, False, False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def _pairs(self, proto) -> None:
        """Every way to put an entry together from two; an entry's rank is its place by score."""
        entries = {p.piece.replace(SPACE, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        byte_id = {self.bytes_of[i]: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        long = sorted((x for x in entries if len(x) > 1), key=lambda x: -proto.pieces[entries[x]].score)
        whole = all(c in entries for x in long for c in x)
        self.own = proto.trainer_spec.model_type == BPE and {p.type for p in proto.pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE} and whole
        if not self.own:
            return
        place = {score: rank for rank, score in enumerate(dict.fromkeys(proto.pieces[entries[x]].score for x in long))}
        found = [(entries[x[:k]], entries[x[k:]], place[proto.pieces[entries[x]].score], entries[x]) for x in long for k in range(1, len(x)) if x[:k] in entries and x[k:] in entries]
        left, right, rank, made = np.array(found, np.int64).reshape(-1, 4).T
        self.pairs = merges.PairTable(left, right, rank.astype(np.int32), made.astype(np.int32))
        self.character = np.full(0x110000, -1, np.int32)
        for x, i in entries.items():
            if len(x) == 1:
                self.character[ord(x)] = i
        self.byte = np.array([byte_id.get(bytes([b]), -1) for b in range(256)], np.int32)

    def marked(self, text: str) -> str:
        """Normalised text with spaces for marks."""
        return self.normalise(text).replace(SPACE, " ")

    def encode(self, values: list[str]) -> Encoded:
        """All of several texts."""
        marked = [self.marked(t).encode() if t else b"" for t in values]
        sizes = np.array(list(map(len, marked)), np.int64)
        if not sizes.sum():
            empty = np.empty(0, "<i4")
            return Encoded(*([x] * len(values) for x in (empty, b"", empty, b"")))
        data = np.frombuffer(b"".join(marked), np.uint8)
        begins = np.cumsum(sizes) - sizes
        heads = np.zeros(len(data), bool)
        if self.cuts:
            space = data == 0x20
            heads[1:] = space[1:] & ~space[:-1]
        heads[begins[sizes > 0]] = True
        starts = np.flatnonzero(heads)
        edges = np.append(np.searchsorted(starts, begins), len(starts))
        places, chunks, offsets = merges.distinct(data, starts)
        ids, counts, lengths = self._ids(chunks, offsets)
        of_text = pa.array(places)
        flat, at = merges.joined(merges.ragged(ids, counts).take(of_text))
        flat_lengths, _ = merges.joined(merges.ragged(lengths, counts).take(of_text))
        all_ids, all_lengths = np.frombuffer(flat, "<i4"), np.frombuffer(flat_lengths, "<i4")
        shown, digits = (self._spelt(table, ids, counts).take(of_text) for table in (self.shown, self.decimals))
        shown, shown_at = merges.joined(shown)
        digits, digits_at = merges.joined(digits)
        runs = lambda cuts: list(zip(cuts[edges].tolist(), cuts[edges].tolist()[1:], strict=False))
        decoded = [bytes(shown[a:b]) for a, b in runs(shown_at)]
        if self.strip_first:
            decoded = [x.removeprefix(b" ") for x in decoded]
        id_runs = runs(at // 4)
        return Encoded([all_ids[a:b] for a, b in id_runs], decoded, [all_lengths[a:b] for a, b in id_runs], [bytes(digits[a : max(a, b - 1)]) for a, b in runs(digits_at)])

    @staticmethod
    def _spelt(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The table's entries of each chunk's ids as one value per chunk."""
        data, at = merges.joined(table.take(pa.array(ids)))
        cuts = at[np.append(0, np.cumsum(counts))]
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])

    def _ids(self, chunks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, their number per chunk, and the bytes of marked text that each stands for."""
        n = len(offsets) - 1
        raw = chunks.tobytes()
        if not self.own:
            return self._by_library([raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)])
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        is_head = (chunks & 0xC0) != 0x80
        position = np.cumsum(is_head)  # characters up to and with each byte
        begins = position[offsets[:-1]] - 1
        chunk = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(begins, len(points))))
        symbol = self.character[points]
        bare = symbol < 0
        width = np.diff(np.append(np.flatnonzero(is_head), len(chunks)))
        fresh = np.ones(len(points), bool)
        fresh[1:] = (chunk[1:] != chunk[:-1]) | bare[1:] | bare[:-1]
        run = np.cumsum(fresh, dtype=np.int32) - 1
        library = np.zeros(n, bool)
        library[chunk[np.bincount(run)[run] > merges.LONGEST]] = True
        if (self.byte < 0).any():
            library[chunk[bare]] = True
        own = ~library[chunk]
        symbol, bare, width, fresh, chunk = symbol[own], bare[own], width[own], fresh[own], chunk[own]
        spread = np.where(bare, width, 1)  # a bare character is as many symbols as it has bytes
        symbols = np.repeat(symbol, spread)
        if bare.any():
            own_bytes = chunks[np.repeat(own, np.diff(np.append(np.flatnonzero(is_head), len(chunks))))]
            symbols[np.repeat(bare, spread)] = self.byte[own_bytes[np.repeat(bare, width)]]
            first = np.ones(len(symbols), bool)
            first[np.cumsum(spread) - spread] = fresh  # the other bytes of a character begin a run each
        else:
            first = fresh
        heads = np.flatnonzero(first)
        merged, parts = merges.merge(symbols, np.diff(np.append(heads, len(symbols))), self.pairs)
        counts = np.bincount(np.repeat(chunk, spread)[heads], parts, n).astype(np.int64) if len(heads) else np.zeros(n, np.int64)
        merged = merged.astype("<i4")
        others = np.flatnonzero(library)
        if not len(others):
            return merged, counts, self.shown_size[merged]
        foreign_ids, foreign_counts, foreign_lengths = self._by_library([raw[offsets[k] : offsets[k + 1]].decode() for k in others])
        counts[others] = foreign_counts
        foreign = np.repeat(library, counts)
        ids, lengths = np.empty(counts.sum(), "<i4"), np.empty(counts.sum(), "<i4")
        ids[foreign], lengths[foreign] = foreign_ids, foreign_lengths
        ids[~foreign], lengths[~foreign] = merged, self.shown_size[merged]
        return ids, counts, lengths

    def _by_library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts, lengths = [], [], []
        for chunk in chunks:
            found = self.processor.encode(chunk.replace(" ", SPACE), num_threads=1)
            ids += found
            counts.append(len(found))
            if self.unknown in found:
                surfaces = self.processor.encode(chunk.replace(" ", SPACE), out_type="immutable_proto").pieces
                lengths += [len(p.surface.replace(SPACE, " ").encode()) for p in surfaces]
            else:
                lengths += [int(self.shown_size[i]) for i in found]
        return np.array(ids, "<i4"), np.array(counts, np.int64), np.array(lengths, "<i4")

    def spans(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in the source of each piece."""
        edges = np.append(0, np.cumsum(lengths, dtype=np.int64))
        if len(edges) == 1:
            return edges[:0], edges[:0]
        if self.normalise.plain and SPACE not in text:
            projected = np.maximum(edges - self.normalise.dummy, 0)
        else:
            normal, align = self.normalise.aligned(text)
            data = np.frombuffer(normal.encode(), np.uint8)
            inside = np.zeros(len(data) + 1, bool)  # the later bytes of space marks, which a marked text lacks
            marks = np.flatnonzero((data[:-2] == SPACE_BYTES[0]) & (data[1:-1] == SPACE_BYTES[1]) & (data[2:] == SPACE_BYTES[2]))
            inside[marks + 1] = inside[marks + 2] = True
            projected = align[~inside][edges]
        return projected[:-1], projected[1:]


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process and path, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


#: Columns an encoding may return, with their types.
OUTPUTS = {
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "span_bytes": "long",
    "spans_crc32": "long",
}


def _encode_partition(path: str, outputs: tuple[str, ...]):
    spans_wanted = {"begins", "ends", "span_bytes", "spans_crc32"} & set(outputs)

    def rows(encoder: PieceEncoder, values: list[str]) -> dict:
        done = encoder.encode(values)
        spans = [encoder.spans(t, x) for t, x in zip(values, done.lengths, strict=True)] if spans_wanted else []
        made = {
            "ids": lambda: done.ids,
            "begins": lambda: [a.astype(np.int32) for a, _ in spans],
            "ends": lambda: [b.astype(np.int32) for _, b in spans],
            "decoded": lambda: [x.decode() for x in done.decoded],
            "n_tokens": lambda: list(map(len, done.ids)),
            "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in done.decimals],
            "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in done.decoded],
            "span_bytes": lambda: [int((b - a).sum()) for a, b in spans],
            "spans_crc32": lambda: [zlib.crc32(np.stack([a, b], 1).astype("<u4").tobytes()) for a, b in spans],
        }
        return {name: made[name]() for name in outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
        for batch in batches:
            for low, high in merges.slices(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(low, high - low)
                columns = rows(encoder, part.column(1).to_pylist())
                arrays = [pa.array(c, kinds[OUTPUTS[name]]) for name, c in columns.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *outputs])

    return run


def encode(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """One row per document: doc_id and the named OUTPUTS of its whole text.

    begins and ends are byte positions in the source's UTF-8; a piece made by normalisation alone (a
    leading space mark) has an empty span. decoded is the text that the ids stand for. A null or empty
    text has no ids. Rows are independent: nothing is shuffled, and repeated or null doc_ids pass
    through. Extra columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return texts(docs).mapInArrow(_encode_partition(model_path, tuple(outputs)), schema)


def op9_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return encode(documents(spark, sf_dir), path, ("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_crc32"))
