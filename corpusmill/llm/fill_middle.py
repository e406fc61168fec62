"""Fill-in-middle transformation of texts kept as seekable compressed frames.

A text is a sequence of units: a word with the white space before it, or white space at the end. ``store`` writes it as independent
zstandard frames of about ``FRAME_BYTES``, cut between units, each with the number of units and code points up to its end. A cut
after so many units is found by a search in those numbers, and only its frame is decompressed; the output is streamed frame by
frame, in the order of its form, into a digest or a text.

Two hashed places cut a text into prefix, middle and suffix. Forms: plain (the text as it is), psm (``<P>`` prefix ``<S>`` suffix
``<M>`` middle) and spm (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). A text that holds a mark stays plain, so the marks of an
output are its own and the text can be rebuilt from output and form.

Null and empty texts have no units and stay plain. A null doc_id is hashed as the empty text. Rows that repeat are cut alike, each for
itself. A text of any length is taken whole; a unit longer than a frame has one of its own. Other columns, whatever their names,
are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import byte_texts, new_folder

FRAME_BYTES = 1 << 16
MARKS = (b"<P>", b"<S>", b"<M>")
#: Of 100 texts so many are transformed, and of 100 of those so many as spm.
RATE, SPM_RATE = 50, 80
SEED = 42

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STORED = "doc_id long, marked boolean, units array<long>, chars array<long>, sizes array<long>, frames array<binary>"


def unit_ends(text: bytes) -> np.ndarray:
    """The byte after each unit."""
    if not text:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.append(ends, len(text))


def n_chars(data: bytes) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def frames_of(text: bytes, pack, frame_bytes: int = FRAME_BYTES) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """Cumulative units and code points, sizes in bytes, and the frames themselves."""
    ends = unit_ends(text)
    units, chars, sizes, frames = [], [], [], []
    begin = done = points = 0
    while done < len(ends):
        done = max(done + 1, int(np.searchsorted(ends, begin + frame_bytes, "right")))
        part = text[begin : int(ends[done - 1])]
        points += n_chars(part)
        units.append(done)
        chars.append(points)
        sizes.append(len(part))
        frames.append(pack(part))
        begin += len(part)
    return units, chars, sizes, frames


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Writes all texts as frames in the shared folder: doc_id, marked (the text holds a mark), units and chars (cumulative), sizes,
    frames; a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            marked, found = [], []
            for text in byte_texts(batch.column(1)):
                marked.append(any(m in text for m in MARKS))
                found.append(frames_of(text, pack, frame_bytes))
            long, blob = pa.list_(pa.int64()), pa.list_(pa.binary())
            columns = [batch.column(0), pa.array(marked, pa.bool_()), *(pa.array([f[i] for f in found], k) for i, k in enumerate((long, long, long, blob)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "marked", "units", "chars", "sizes", "frames"])

    path = new_folder(docs.sparkSession, "frames")
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, _STORED)
    rows.write.option("compression", "uncompressed").parquet(path)  # frames don't shrink further
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


class Frames:
    """A stored text: units up to a cut, and the bytes between cuts."""

    def __init__(self, units: list[int], chars: list[int], sizes: list[int], frames: list[bytes], unpack):
        self.units, self.chars, self.sizes, self.frames, self.unpack = units, chars, sizes, frames, unpack
        self.n = units[-1] if units else 0

    def place(self, cut: int) -> tuple[int, int, int]:
        """The frame that holds the end of the first ``cut`` units, the byte in it, and the code points before."""
        if not cut:
            return 0, 0, 0
        k = bisect_left(self.units, cut)
        if self.units[k] == cut:
            return k, self.sizes[k], self.chars[k]
        data = self.unpack(self.frames[k])
        at = int(unit_ends(data)[cut - 1 - (self.units[k - 1] if k else 0)])
        return k, at, (self.chars[k - 1] if k else 0) + n_chars(data[:at])

    def between(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The text between two places, frame by frame."""
        for k in range(begin[0], end[0] + 1 if self.frames else 0):
            a, b = begin[1] if k == begin[0] else 0, end[1] if k == end[0] else self.sizes[k]
            if a < b:
                yield self.unpack(self.frames[k])[a:b]


def choices(doc_id: int | None, n: int, plain: bool, seed: int = SEED) -> tuple[str, int, int]:
    """Form, and the units before the middle and up to its end."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "plain" if plain or h3 % 100 >= RATE else "spm" if h4 % 100 < SPM_RATE else "psm", *cuts


def output(text: Frames, form: str, places: tuple[tuple[int, int, int], ...]) -> Iterator[bytes]:
    """The transformed text in pieces. places: begin, begin and end of the middle, end."""
    begin, a, b, end = places
    parts = {"plain": ((None, begin, end),), "psm": ((b"<P>", begin, a), (b"<S>", b, end), (b"<M>", a, b)), "spm": ((b"<S>", b, end), (b"<P>", begin, a), (b"<M>", a, b))}
    for mark, x, y in parts[form]:
        if mark:
            yield mark
        yield from text.between(x, y)


def restored(out: bytes, form: str) -> Iterator[bytes]:
    """The text in pieces, from the transformed one and its form."""
    if form == "plain":
        return iter((out,))
    order = (b"<P>", b"<S>", b"<M>") if form == "psm" else (b"<S>", b"<P>", b"<M>")
    at = [0, out.index(order[1]), out.rindex(order[2]), len(out)]
    parts = {m: out[at[k] + 3 : at[k + 1]] for k, m in enumerate(order)}
    return iter((parts[b"<P>"], parts[b"<M>"], parts[b"<S>"]))


def transform(stored: DataFrame, seed: int = SEED, texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``texts``, output, of every stored text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"][: 8 if texts else 7]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, marked, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = Frames(*parts, unpack)
                form, a, b = choices(doc_id, text.n, marked or not text.n, seed)
                ends = (0, 0, 0), (len(text.frames) - 1, text.sizes[-1], text.chars[-1]) if text.n else (0, 0, 0)
                places = (ends[0], *((text.place(a), text.place(b)) if form != "plain" else ends), ends[1])
                pieces, digest, again = [], hashlib.sha256(), hashlib.sha256()
                for piece in output(text, form, places):
                    digest.update(piece)
                    pieces.append(piece)
                out = b"".join(pieces)
                for piece in restored(out, form):
                    again.update(piece)
                chars = (None, None) if form == "plain" else (places[1][2], places[2][2] - places[1][2])
                rows.append((doc_id, text.n, form, *chars, digest.hexdigest(), again.hexdigest(), *([out.decode()] if texts else [])))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names=names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    return stored.mapInArrow(run, schema)
