"""Token-id output: id arrays with Elias-Fano document boundaries.

Texts are encoded with the ``tokenizers`` library; an end id follows each
document.  Documents are dealt by ranges of their id, so that file order is
document order, and each partition writes one file:

    magic   8 bytes   ``MLEF0002``
    ids     the ids of all documents, one after another, 2 or 4 bytes each
    bounds  Elias-Fano parts of the documents' end offsets
    docs    Elias-Fano parts of the documents' ids, less the smallest
    trailer 13 x int64 (little-endian): documents, ids, bytes of an id, documents
            without an id, smallest id, and for each sequence its largest value
            and the bits of its low values, the bytes of its low and high part

An Elias-Fano sequence has three parts:

    low     values of l bits: the low bits of each value
    high    unary-coded high bits: bit (value >> l) + i is set for value i
    hints   uint64 position of every ``HINT``-th set bit, for select

That takes about 2 + log2(u / n) bits a document in place of 64; select answers
from the nearest hint.  Ids are written as they are made, the sequences after
them, so a writer holds one slice of texts; a reader fetches the sequences and
then only the ids of the documents it asks for, by their offset.

Encoding reuses work: a byte-level pre-tokenizer always cuts before a single space
or line break between two visible characters, and between a letter and a mark
(``.,;:!?``).  Texts are cut there (as offsets into the batch's own bytes), equal
pieces of a slice are encoded once, and their ids are gathered for every place.
The ids are those of encoding the whole text with ``add_special_tokens=False``: a
text that spells a special token gets its id.  Texts stay whole where another
kind of tokenizer is given.

Files are written beside their final name and renamed, with the same bytes on
every attempt, so retried and speculative tasks are harmless.

Defined cases: null and empty texts hold the end id alone; documents that repeat
an id stand next to each other, by their text; null ids come first and are read
back as null; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import parts, release, scratch_path

MAGIC = b"MLEF0002"
TRAILER = struct.Struct("<13q")
HINT = 256
#: Bytes of text that are encoded at a time.
ENCODED = 8_000_000
#: Bytes of distinct pieces in one call of the tokenizer.
CALL = 1 << 14
#: Distinct pieces whose ids are remembered, beside those of the last slice.
KNOWN = 1 << 19
#: Pieces whose ids are gathered at a time, documents and ids that are read at a time.
GATHERED, READ_DOCS, READ_IDS = 1 << 18, 1024, 1 << 22


# --- Elias-Fano -----------------------------------------------------------------


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another, little-endian."""
    out = []
    for a in range(0, len(values) if width else 0, 1 << 16):
        bits = (values[a : a + (1 << 16), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(raw: bytes, width: int, index: np.ndarray) -> np.ndarray:
    """The values of ``width`` bits at the given places of a packed array."""
    out = np.zeros(len(index), dtype=np.uint64)
    data = np.frombuffer(raw, dtype=np.uint8)
    for k in range(width):
        at = index * width + k
        out |= ((data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
    return out


class EliasFano:
    """A monotone sequence in near-minimal space, with select."""

    def __init__(self, n: int, universe: int, width: int, low: bytes, high: bytes, hints: np.ndarray):
        self.n, self.universe, self.width = n, universe, width
        self.low, self.high, self.hints = low, high, hints

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return cls(n, universe, width, pack_bits(values, width), high, ones[::HINT].astype("<u8"))

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return self.universe, self.width, len(self.low), len(self.high)

    def parts(self) -> bytes:
        return b"".join([self.low, self.high, self.hints.tobytes()])

    @staticmethod
    def size(n: int, shape: tuple[int, int, int, int]) -> int:
        return shape[2] + shape[3] + 8 * -(-n // HINT)

    @classmethod
    def read(cls, n: int, shape: tuple[int, int, int, int], raw: bytes) -> EliasFano:
        universe, width, low, high = shape
        return cls(n, universe, width, raw[:low], raw[low : low + high], np.frombuffer(raw, "<u8", -(-n // HINT), low + high))

    def select(self, i: int) -> int:
        """The i-th value; reads the high part from the nearest hint on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rank = int(self.hints[i // HINT]), i // HINT * HINT
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while True:
            ones = word.bit_count()
            if rank + ones > i:
                for _ in range(i - rank):
                    word &= word - 1
                place = byte * 8 + (word & -word).bit_length() - 1
                break
            rank += ones
            byte += 1
            word = self.high[byte]
        low = int(unpack_bits(self.low, self.width, np.array([i]))[0])
        return (place - i) << self.width | low

    def values(self, a: int, b: int) -> np.ndarray:
        """The values from a to b, the end exclusive, by a sweep of the high part between the hints around them."""
        if a >= b:
            return np.zeros(0, dtype=np.uint64)
        first, behind = a // HINT, -(-b // HINT)
        begin = int(self.hints[first]) >> 3
        end = (int(self.hints[behind]) >> 3) + 1 if behind < len(self.hints) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin, begin), bitorder="little")) + 8 * begin
        ones = ones[ones >= int(self.hints[first])]
        index = np.arange(a, b)
        highs = (ones[index - first * HINT] - index).astype(np.uint64)
        return (highs << np.uint64(self.width)) | unpack_bits(self.low, self.width, index)

    def all(self) -> np.ndarray:
        return self.values(0, self.n)


# --- the file ---------------------------------------------------------------------


class TokenWriter:
    """Writes ids as they come, then the boundaries and the documents' ids, which must ascend (nulls first)."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.lengths, self.docs, self.nulls = out, id_bytes, [], [], 0
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.nulls += doc_ids.null_count
        self.docs.append(doc_ids.drop_null().to_numpy().astype(np.int64))
        self.lengths.append(lengths)
        self.out.write(np.ascontiguousarray(ids))

    def close(self) -> tuple[int, int]:
        """The numbers of documents and ids."""
        ends = np.cumsum(np.concatenate(self.lengths)) if self.lengths else np.zeros(0, np.int64)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        n, ids, base = len(ends), int(ends[-1]) if len(ends) else 0, int(docs[0]) if len(docs) else 0
        bounds, own = EliasFano.encode(ends), EliasFano.encode(docs.view(np.uint64) - np.int64(base).view(np.uint64))
        self.out.write(bounds.parts())
        self.out.write(own.parts())
        # The largest id less the smallest may need 64 bits: it is kept as the bits of an int64.
        span = int(np.uint64(own.universe).view(np.int64))
        self.out.write(TRAILER.pack(n, ids, self.id_bytes, self.nulls, base, *bounds.shape, span, *own.shape[1:]))
        return n, ids


class TokenFile:
    """Random access to the documents of one file (a seekable ``pyarrow.NativeFile``)."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        if size < len(MAGIC) + TRAILER.size or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        n, u, self.id_bytes, self.nulls, base, *shapes = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        self.n, self.base = n, base
        one, two = tuple(shapes[:4]), (shapes[4] & 0xFFFFFFFFFFFFFFFF, *shapes[5:])
        a, b = EliasFano.size(n, one), EliasFano.size(n - self.nulls, two)
        raw = source.read_at(a + b, size - TRAILER.size - a - b)
        self.ends, self.docs = EliasFano.read(n, one, raw[:a]), EliasFano.read(n - self.nulls, two, raw[a:])
        self.kind = "<u2" if self.id_bytes == 2 else "<u4"

    def ids(self, begin: int, end: int) -> np.ndarray:
        width = self.id_bytes
        return np.frombuffer(self.source.read_at((end - begin) * width, len(MAGIC) + begin * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def doc_ids(self, a: int, b: int) -> pa.Array:
        own = self.docs.values(max(0, a - self.nulls), max(0, b - self.nulls)) + np.int64(self.base).view(np.uint64)
        empty = max(0, min(b, self.nulls) - a)
        return pa.concat_arrays([pa.nulls(empty, pa.int64()), pa.array(own.view(np.int64))])

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, end offsets of it and those behind it) in blocks of bounded size."""
        a = 0
        while a < self.n:
            begin = self.ends.select(a - 1) if a else 0
            ends = self.ends.values(a, min(self.n, a + READ_DOCS)).astype(np.int64)
            many = max(1, int(np.searchsorted(ends, begin + READ_IDS, "right")))
            yield a, ends[:many]
            a += many


# --- encoding -----------------------------------------------------------------------

#: Bytes that are visible characters by themselves (0), others (1), and continued ones (2: looked at further).
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = 0
_CLASS[0x80:] = 2
#: Bytes that may begin a piece: 1 white space, 2 marks; and ASCII letters.
_BEGINS = np.zeros(256, dtype=np.uint8)
_BEGINS[[0x20, 0x0A]] = 1
_BEGINS[list(b".,;:!?")] = 2
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _blank_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two bytes begin a character that may be white space beyond ASCII (or another of its block)."""
    latin = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    ogham, cjk = (first == 0xE1) & (second == 0x9A), (first == 0xE3) & (second == 0x80)
    return latin | ogham | cjk | ((first == 0xE2) & ((second == 0x80) | (second == 0x81)))


def _visible_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a visible character begins at each place; ``data`` goes on for two bytes behind the last."""
    kind = _CLASS[data[at]]
    ok = kind == 0
    far = np.flatnonzero(kind == 2)
    ok[far] = ~_blank_pair(data[at[far]], data[at[far] + 1])
    return ok


def _visible_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a visible character ends before each place; ``data`` begins three bytes before the first."""
    kind = _CLASS[data[at - 1]]
    ok = kind == 0
    far = at[kind == 2]
    ok[kind == 2] = ~(_blank_pair(data[far - 3], data[far - 2]) | _blank_pair(data[far - 2], data[far - 1]))
    return ok


def _letter_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an ASCII or Latin-1 letter ends before each place."""
    last = data[at - 1]
    return _LETTER[last] | ((data[at - 2] == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, three zeros around them, and where each value begins (and the last ends) in them."""
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(3, np.uint8)]), begins - begins[0] + 3


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    behind = np.cumsum(lengths)
    return np.arange(behind[-1] if len(behind) else 0) + np.repeat(starts - behind + lengths, lengths)


class Encoder:
    """Encodes texts to ids of the narrowest width, the end id behind each."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind, self.end_id = "<u2" if size <= 1 << 16 else "<u4", end_id
        said = json.loads(self.tokenizer.to_str())
        by_byte = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (said["pre_tokenizer"] or {}).items()
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,;:!?]", t["content"])) for t in said["added_tokens"])
        self.cuts = by_byte and plain and not said["normalizer"] and not said["post_processor"]
        self.known, self.ids = pa.array([], pa.binary()), np.zeros(0, self.kind)
        self.starts = self.lengths = np.zeros(0, np.int64)
        # In the byte alphabet a space is U+0120 and a line break U+010A.
        self.spaced = np.zeros(size, dtype=bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] in ("\u0120", "\u010a")]] = True

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, dtype=self.kind) for e in encode(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of distinct pieces, and where those of each are.

        Pieces of a space or line break and visible characters are joined for the
        call: the tokenizer cuts before each, and only a piece's first id begins so.
        """
        data, begins = _bytes_of(pieces)
        spaces = np.cumsum(_BEGINS[data] == 1)
        first, end = begins[:-1], begins[1:]
        joined = (end - first >= 2) & (_BEGINS[data[first]] == 1) & (spaces[end - 1] == spaces[first]) & self.cuts
        at = np.flatnonzero(joined)
        joined[at] = _visible_at(data, first[at] + 1) & _visible_before(data, end[at])
        ids, lengths = [], np.zeros(len(pieces), dtype=np.int64)
        starts, total = np.zeros(len(pieces), dtype=np.int64), 0
        at = np.flatnonzero(joined)
        behind = np.cumsum(end[at] - first[at])
        calls = np.searchsorted(behind, np.arange(0, behind[-1] if len(at) else 0, CALL))
        calls = np.unique(np.append(calls, len(at)))
        clean = data[_runs(first[at], end[at] - first[at])].tobytes()
        places = np.concatenate([[0], behind])
        texts = [clean[places[a] : places[b]].decode("utf-8", "replace") for a, b in zip(calls, calls[1:], strict=False)]
        alone = [np.flatnonzero(~joined)]
        for a, b, got in zip(calls, calls[1:], self._each(texts), strict=False):
            begin = np.flatnonzero(self.spaced[got])
            if len(begin) != b - a:
                alone.append(at[a:b])
                continue
            ids.append(got)
            starts[at[a:b]] = begin + total
            lengths[at[a:b]] = np.diff(np.append(begin, len(got)))
            total += len(got)
        rest = np.concatenate(alone)
        for k, got in zip(rest, self._each([data[first[k] : end[k]].tobytes().decode("utf-8", "replace") for k in rest]), strict=True):
            ids.append(got)
            starts[k], lengths[k] = total, len(got)
            total += len(got)
        return np.concatenate(ids) if ids else np.zeros(0, self.kind), starts, lengths

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_pieces``; the pieces of former slices are remembered, up to ``KNOWN`` of them."""
        at = pa.compute.index_in(pieces, value_set=self.known)
        new = pa.compute.is_null(at)
        ids, starts, lengths = self._pieces(pieces.filter(new))
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        mask = new.to_numpy(zero_copy_only=False)
        place[mask] = len(self.known) + np.arange(len(starts))
        starts = np.concatenate([self.starts, starts + len(self.ids)])
        ids, lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        if len(starts) <= KNOWN:
            self.known = pa.concat_arrays([self.known, pieces.filter(new)])
            self.ids, self.starts, self.lengths = ids, starts, lengths
        else:
            self.known, self.lengths = pieces, lengths[place]
            self.ids, self.starts = ids[_runs(starts[place], self.lengths)], np.cumsum(self.lengths) - self.lengths
        return ids, starts[place], lengths[place]

    def _cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin: each text, and inside it the places where the tokenizer always cuts."""
        cut = np.zeros(len(data), dtype=bool)
        if self.cuts:
            kind = _BEGINS[data]
            space = np.flatnonzero(kind == 1)
            cut[space[_visible_at(data, space + 1) & _visible_before(data, space)]] = True
            mark = np.flatnonzero(kind == 2)
            cut[mark[_letter_before(data, mark)]] = True
            # White space at a text's end stands before no character of it.
            cut[begins[1:] - 1] = False
            last = begins[1:] - 1
            last = last[kind[last] == 2]
            cut[last] = _letter_before(data, last)
        cut[begins[1:]] = cut[begins[:1]] = False
        cut[begins[:-1][begins[:-1] < begins[1:]]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all texts, one after another, and the number of each text's ids."""
        data, begins = _bytes_of(texts.cast(pa.binary()).fill_null(b""))
        cuts = self._cuts(data, begins)
        offsets = np.append(cuts, begins[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        ids, starts, lengths = self._coded(coded.dictionary)
        sizes = lengths[code]
        out = np.empty(int(sizes.sum()) + len(texts), dtype=self.kind)
        # Behind the ids of each text stands the end id.
        own = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, begins)]
        ends = own[1:] + np.arange(1, len(texts) + 1)
        out[ends - 1] = self.end_id
        free = np.ones(len(out), dtype=bool)
        free[ends - 1] = False
        made = np.empty(int(sizes.sum()), dtype=self.kind)
        at = 0
        for a in range(0, len(code), GATHERED):
            some = code[a : a + GATHERED]
            got = ids[_runs(starts[some], lengths[some])]
            made[at : at + len(got)] = got
            at += len(got)
        out[free] = made
        return out, np.diff(own) + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# --- Spark ----------------------------------------------------------------------------


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 2,
    partitions: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode and write all documents; returns (file, n_docs, n_ids) of each file.

    ``folder`` is a URI that driver and executors share.  ``partitions`` is the
    number of files; by default that of the input's splits, so that a file's size
    does not grow with the corpus.
    """
    n = partitions or max(1, docs.rdd.getNumPartitions())
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    dealt = (
        docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
        .repartitionByRange(n, "id")
        .sortWithinPartitions("id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():07d}.mlef"
        fs, path = pa.fs.FileSystem.from_uri(folder)
        attempt = f"{path}/_{name}.{context.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            for part in parts(batch, 1, ENCODED):
                encode = encoder(tokenizer_path, end_id)
                if out is None:
                    out = fs.open_output_stream(attempt)
                    writer = TokenWriter(out, np.dtype(encode.kind).itemsize)
                ids, lengths = encode(part.column(1))
                writer.add(part.column(0), lengths, ids)
                del ids, lengths, part
            del batch
            release()
        if out is None:
            return
        n_docs, n_ids = writer.close()
        out.close()
        fs.move(attempt, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["file", "n_docs", "n_ids"]
        )

    written = dealt.mapInArrow(run, "file string, n_docs bigint, n_ids bigint")
    manifest = f"{folder}/_manifest"
    written.write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.schema(written.schema).parquet(manifest)


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` counts the ids of all documents before it, over all files;
    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers.
    Each task opens one file and reads blocks of it by their offset.
    """
    before = F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")
    files = manifest.select("file", before.alias("before")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as source:
                    found = TokenFile(source)
                    for a, ends in found.blocks():
                        begins = np.append(found.ends.select(a - 1) if a else 0, ends[:-1])
                        ids = found.ids(int(begins[0]), int(ends[-1])).astype("<u4")
                        sums = [zlib.crc32(ids[x:y]) for x, y in zip(begins - begins[0], ends - begins[0], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [found.doc_ids(a, a + len(ends)), pa.array(begins + start), pa.array(ends - begins), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
        release()

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, **options) -> DataFrame:
    """Write all documents and read them back; see ``write_tokens`` and ``read_tokens``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = write_tokens(docs, tokenizer_path, folder, end_id, **options)
    return read_tokens(spark, folder, manifest)
