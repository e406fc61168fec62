"""SentencePiece encoding that keeps byte offsets, and decoding.

``encode`` normalises texts by longest-prefix replacement through the model's compiled character map, remembering for
every normalised byte the byte of the original that it came from; segments the normalised text with the model's BPE; and
projects every piece back to its span of original bytes through that alignment. ``decode`` joins pieces again.

All steps work on the bytes of a few hundred texts at once: the trie is walked from every place together, spaces are
squeezed and marked by masks, and the words that a task hasn't met lately are segmented side by side, a merge each a round.

Null texts count as empty and give empty arrays. Spans are adjoining: piece i covers the original bytes
``bounds[i]:bounds[i + 1]``. Every row in gives one row out, in any order and however often it repeats; an empty table gives
none. A text of any length is one row; words longer than ``MATRIX`` characters are segmented with a heap, in n log n. Kept
columns that are named like a result give way to it.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, with_text

SPACE = "▁"
#: Piece kinds of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A task remembers the pieces of so many words.
WORDS = 300_000
#: Words of at most so many characters are segmented side by side.
MATRIX = 64
#: Texts that are encoded at once.
TEXTS = 256
#: Symbols: a character is its code point, a longer piece this plus its id.
PIECE = 0x110000
#: Rank of a pair that isn't a piece.
NEVER = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message; floats stay four raw bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 keys, whose values are offsets of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.append(np.flatnonzero(self.texts == 0), len(self.texts))
        #: Length of the replacement that begins at each offset.
        self.sizes = ends[np.searchsorted(ends, np.arange(len(self.texts)))] - np.arange(len(self.texts))

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places at which a key begins, the length of the longest one, and the offset of its replacement. ``ends``: for each
        place where its text ends; all places walk down the trie together."""
        length, value = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        units = self.units
        if not len(units):
            return length[:0], length[:0], value[:0]
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at, depth = np.arange(len(data)), 0
        node = np.full(len(data), offset(int(units[0])))
        while len(at):
            byte = data[at + depth].astype(np.int64)
            node = node ^ byte
            unit = units[np.minimum(node, len(units) - 1)]
            ok = (node < len(units)) & (unit & 0x800000FF == byte)
            at, node, unit = at[ok], node[ok], unit[ok]
            node = node ^ offset(unit)
            depth += 1
            leaf = unit & 256 != 0
            length[at[leaf]] = depth
            value[at[leaf]] = units[node[leaf]] & 0x7FFFFFFF
            more = at + depth < ends[at]
            at, node = at[more], node[more]
        found = np.flatnonzero(length)
        return found, length[found], value[found]


def accepted(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which matches a reader from left to right takes: those that don't begin inside one that it took."""
    take = np.ones(len(places), bool)
    if (places[1:] < places[:-1] + lengths[:-1]).any():
        end = -1
        for k, (at, n) in enumerate(zip(places.tolist(), lengths.tolist(), strict=True)):
            take[k] = at >= end
            end = at + n if at >= end else end
    return take


class Model:
    """Pieces and normaliser of a BPE model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        charmap, self.dummy_prefix, self.squeeze, self.escape, kind_of_model = b"", True, True, True, 1
        with open(path, "rb") as file:
            data = file.read()
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x.get(1, b"").decode())
                scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(x.get(3, NORMAL))
            elif field == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif field == 3:
                x = dict(_fields(value))
                charmap = x.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(x.get(k, 1)) for k in (3, 4, 5))
        if kind_of_model != 2 or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.charmap = CharMap(charmap)
        normal = [(i, p, s) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds, strict=True)) if k == NORMAL]
        ranks = np.unique([-s for _, _, s in normal], return_inverse=True)[1] if normal else []
        #: piece -> (rank, symbol); the least rank is joined first, and equal ranks from the left.
        self.symbol = {p: (int(r), ord(p) if len(p) == 1 else PIECE + i) for (i, p, _), r in zip(normal, ranks, strict=True)}
        self.unknown = self.kinds.index(UNKNOWN)
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32) if len(bytes_) == 256 else None
        #: No piece holds a space mark after another character, so no merge crosses such a place: words are independent.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for _, p, _ in normal)
        #: Of each symbol its id (-1: none) and its bytes.
        self.id = np.full(PIECE + len(self.pieces), -1, np.int32)
        self.id[PIECE:] = np.arange(len(self.pieces))
        self.width = np.ones(len(self.id), np.int32)
        for least in (0x80, 0x800, 0x10000):
            self.width[least:PIECE] += 1
        for i, p, _ in normal:
            if len(p) == 1:
                self.id[ord(p)] = i
            else:
                self.width[PIECE + i] = len(p.encode())
        joins = {}
        for p, (rank, joint) in self.symbol.items():
            for k in range(1, len(p)):
                left, right = (ord(x) if len(x) == 1 else self.symbol.get(x, (0, -1))[1] for x in (p[:k], p[k:]))
                if left >= 0 and right >= 0:
                    joins[left << 21 | right] = (rank, joint)
        #: Pairs of symbols that make a piece, sorted, their ranks and what they make.
        self.pairs = np.array(sorted(joins), np.int64)
        self.ranks, self.joints = np.array([joins[k] for k in self.pairs.tolist()], np.int64).reshape(-1, 2).T

    def normalize(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that lie end to end in ``data`` between ``edges``: their normalised bytes, the place in ``data`` that each
        of them comes from, the edges of the normalised texts, and where in ``data`` what each text kept ends."""
        sizes = np.diff(edges)
        ends = np.repeat(edges[1:], sizes)
        found, length, value = self.charmap.longest(data, ends)
        source, stop = np.arange(len(data)), np.arange(1, len(data) + 1)
        if len(found):
            take = accepted(found, length)
            found, length, value = found[take], length[take], value[take]
            size = np.ones(len(data), np.int64)
            size[ragged(found, length)] = 0
            new = self.charmap.sizes[value]
            size[found] = new
            stop[found] = found + length
            source = np.repeat(source, size)
            begin = (np.cumsum(size) - size)[found]
            out = data[source]
            out[ragged(begin, new)] = self.charmap.texts[ragged(value, new)]
            data, stop = out, stop[source]
            edges = np.concatenate(([0], np.cumsum(size)))[edges]
        space = data == 32
        if self.squeeze:
            solid = np.concatenate(([0], np.cumsum(~space)))
            text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            seen, all_ = solid[:-1] - solid[edges[text]], solid[edges[text + 1]] - solid[edges[text]]
            again = np.zeros(len(data), bool)
            again[1:] = space[1:] & space[:-1]
            keep = ~(space & ((seen == 0) | (seen == all_) | again))
            edges = np.concatenate(([0], np.cumsum(keep)))[edges]
            data, source, stop, space = data[keep], source[keep], stop[keep], space[keep]
        mark = np.frombuffer((SPACE if self.escape else " ").encode(), np.uint8)
        size = np.where(space, len(mark), 1)
        first = edges[:-1][np.diff(edges) > 0]
        if self.dummy_prefix:
            size[first] += len(mark)
        begin, at = np.cumsum(size) - size, np.repeat(np.arange(len(data)), size)
        out = data[at]
        places = begin[space] + (np.where(np.isin(np.flatnonzero(space), first), len(mark), 0) if self.dummy_prefix else 0)
        for k, byte in enumerate(mark):
            out[places + k] = byte
            if self.dummy_prefix:
                out[begin[first] + k] = byte
        edges = np.concatenate(([0], np.cumsum(size)))[edges]
        last = np.zeros(len(edges) - 1, np.int64)
        some = np.diff(edges) > 0
        last[some] = stop[at[edges[1:][some] - 1]]
        source = source[at]
        if self.squeeze:  # marks that the text itself ends with go as well
            keep = np.ones(len(out), bool)
            for k in np.flatnonzero(some):
                a, b = int(edges[k]), int(edges[k + 1])
                while b - a >= len(mark) and (out[b - len(mark) : b] == mark).all():
                    keep[b - len(mark) : b] = False
                    b -= len(mark)
                    last[k] = source[b]
            if not keep.all():
                edges = np.concatenate(([0], np.cumsum(keep)))[edges]
                out, source = out[keep], source[keep]
        return out, source, edges, last

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the pairs, and whether it is there."""
        key = left.astype(np.int64) << 21 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, (self.pairs[at] == key) & (left >= 0) & (right >= 0)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._pair(left, right)
        return np.where(there, self.ranks[at], NEVER).astype(np.int32)

    def _side_by_side(self, x: np.ndarray) -> np.ndarray:
        """BPE of many words, a row of symbols each, filled up with -1: of every word the adjoining pair of the least rank is
        joined, the leftmost of equals, round after round until no word has one."""
        done, rows = x.copy(), np.arange(len(x))
        rank = self._rank(x[:, :-1], x[:, 1:])
        column = np.arange(x.shape[1])
        while len(rows) and x.shape[1] > 1:
            at = rank.argmin(1)
            live = rank[np.arange(len(rows)), at] < NEVER
            if not live.all():
                done[rows[~live]] = x[~live]
                rows, x, rank, at = rows[live], x[live], rank[live], at[live]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            joint = self.joints[self._pair(x[k, at], x[k, at + 1])[0]]
            beyond = column[None] > at[:, None]
            x[:, :-1] = np.where(beyond[:, :-1], x[:, 1:], x[:, :-1])
            x[:, -1] = -1
            x[k, at] = joint
            rank[:, :-1] = np.where(beyond[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            next_ = np.minimum(at + 1, x.shape[1] - 1)
            own = np.minimum(at, rank.shape[1] - 1)
            rank[k, own] = np.where(at + 1 < x.shape[1], self._rank(x[k, at], x[k, next_]), NEVER)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self._rank(x[some, at[some] - 1], x[some, at[some]])
        return done

    def _by_heap(self, word: str) -> list[int]:
        """BPE of one long word, as symbols."""
        parts, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.symbol.get(joint := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (found[0], i, j, joint))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joint = heapq.heappop(heap)
            if after[i] != j or not parts[i] or not parts[j] or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [ord(p) if len(p) == 1 else self.symbol[p][1] for p in parts if p]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words, one after the other: ids of the pieces, the bytes that each covers (byte pieces of one character: the
        last covers it), and how many pieces each word has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        begin = np.cumsum(length) - length
        symbols, counts = [np.zeros(0, np.int32)] * len(words), np.zeros(len(words), np.int64)
        groups, least = [], 0
        for most in (4, 6, 8, 10, 12, 16, 24, 40, MATRIX):
            at = np.flatnonzero((length > least) & (length <= most))
            least = most
            if len(at):
                x = np.full((len(at), most), -1, np.int32)
                x[np.arange(most)[None] < length[at][:, None]] = flat[ragged(begin[at], length[at])]
                x = self._side_by_side(x)
                counts[at] = (x >= 0).sum(1)
                groups.append((at, x[x >= 0]))
        for k in np.flatnonzero(length > MATRIX).tolist():
            found = np.array(self._by_heap(words[k]), np.int32)
            counts[k] = len(found)
            groups.append((np.array([k]), found))
        starts = np.cumsum(counts) - counts
        symbols = np.zeros(int(counts.sum()), np.int32)
        for at, found in groups:
            symbols[ragged(starts[at], counts[at])] = found
        word = np.repeat(np.arange(len(words)), counts)
        ids, covers = self.id[symbols], self.width[symbols]
        odd = ids < 0
        if odd.any() and self.byte_ids is not None:
            size = np.where(odd, covers, 1)
            raw = np.frombuffer("".join(map(chr, symbols[odd].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            ids, word, last = np.repeat(ids, size), np.repeat(word, size), np.cumsum(size) - 1
            spread = np.zeros(len(ids), np.int32)
            spread[last] = covers
            ids[ids < 0] = self.byte_ids[raw]
            covers = spread
        elif odd.any():  # unknown characters that adjoin are one piece
            first = np.ones(len(ids), bool)
            first[1:] = ~(odd[1:] & odd[:-1] & (word[1:] == word[:-1]))
            covers = np.add.reduceat(covers, np.flatnonzero(first))
            ids, word = np.where(odd, self.unknown, ids)[first], word[first]
        return ids.astype(np.int32), covers.astype(np.int32), np.bincount(word, minlength=len(words))


class Numbered(dict):
    """word -> its number in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1


class Encoder:
    """Encodes texts, word by word where the model allows, and remembers the pieces of words."""

    WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number = Numbered()
        self.ids = self.covers = np.zeros(0, np.int32)
        self.starts = self.counts = np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts end to end in ``data``: ids, edges of the texts among them, bounds, edges of the texts among those."""
        if len(self.number) > WORDS:
            self.forget()
        model, known = self.model, len(self.number)
        normal, source, inner, last = model.normalize(data, edges)
        raw = normal.tobytes()
        cut = self.WORD.findall if model.by_word else lambda text: [text] if text else []
        words = [cut(raw[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(inner.tolist(), inner[1:].tolist(), strict=False)]
        total = sum(map(len, words))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, total)
        if len(self.number) > known:
            new = list(self.number)[known:]
            ids, covers, counts = model.segment(new)
            self.starts = np.concatenate((self.starts, np.cumsum(counts) - counts + len(self.ids)))
            self.counts = np.concatenate((self.counts, counts))
            self.ids, self.covers = np.concatenate((self.ids, ids)), np.concatenate((self.covers, covers))
        of_word = np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype(np.int64)
        where = ragged(self.starts[at], self.counts[at])
        ids, covers = self.ids[where], self.covers[where].astype(np.int64)
        id_edges = np.concatenate(([0], np.cumsum(self.counts[at])))[of_word]
        sizes = np.diff(id_edges)
        # A piece begins where its first normalised byte comes from; a text's last bound is where what it kept ends.
        begin = source[np.cumsum(covers) - covers] - np.repeat(edges[:-1], sizes) if len(ids) else np.zeros(0, np.int64)
        full = sizes > 0
        bound_edges = np.concatenate(([0], np.cumsum(sizes + full)))
        bounds = np.zeros(int(bound_edges[-1]), np.int32)
        bounds[ragged(bound_edges[:-1], sizes)] = begin
        bounds[bound_edges[1:][full] - 1] = (last - edges[:-1])[full]
        return ids, id_edges, bounds, bound_edges


class Decoder:
    """Joins pieces: byte pieces become characters, space marks spaces; the mark that encoding put in front goes."""

    def __init__(self, model: Model):
        self.model = model
        table = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:
                table.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                table.append(b"")
            elif kind == UNKNOWN:
                table.append(" ⁇ ".encode())
            else:
                table.append(piece.replace(SPACE, " ").encode())
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.kinds = np.array(model.kinds)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of id lists that lie end to end."""
        sizes = self.sizes[ids]
        raw = self.flat[ragged(self.starts[ids], sizes)].tobytes()
        cuts = np.concatenate(([0], np.cumsum(sizes)))[edges].tolist()
        kinds = self.kinds[ids]
        # The first piece of each list that isn't a control piece.
        solid = np.append(np.flatnonzero(kinds != CONTROL), len(ids))
        first = solid[np.searchsorted(solid, edges[:-1])]
        normal = np.append(kinds, 0)[first] == NORMAL
        out = []
        for a, b, strip in zip(cuts, cuts[1:], (normal & (first < edges[1:])).tolist(), strict=False):
            text = raw[a:b]
            text = text[1:] if strip and self.model.dummy_prefix and text.startswith(b" ") else text
            out.append(text.decode("utf-8", "replace"))
        return out


def _lists(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """Columns ``keep``, then ids array<int> and bounds array<int> (one more than ids; empty for an empty text), and, where
    ``decoded`` names a column, the text that decoding the ids gives.

    ``model_path`` is a file that every executor has. A model that holds user-defined or unused pieces is refused.
    """
    new = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "bounds")] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    keep = tuple(c for c in keep if c not in {x.name for x in new})
    schema = T.StructType([df.schema[c] for c in keep] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        encoder, decoder = Encoder(model), Decoder(model)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = part.column(len(keep)).fill_null("").cast(pa.large_binary())
                raw, at = [x.as_py() for x in texts], 0
                while at < len(raw) or not at:  # a few megabytes at once
                    end, size = at, 0
                    while end < len(raw) and (end == at or size + len(raw[end]) <= 4 << 20):
                        size += len(raw[end])
                        end += 1
                    edges = np.concatenate(([0], np.cumsum([len(x) for x in raw[at:end]]))).astype(np.int64)
                    ids, id_edges, bounds, bound_edges = encoder.encode(np.frombuffer(b"".join(raw[at:end]), np.uint8), edges)
                    columns = [_lists(ids, id_edges), _lists(bounds, bound_edges)]
                    if decoded:
                        columns.append(pa.array(decoder.decode(ids, id_edges), pa.string()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i).slice(at, end - at) for i in range(len(keep))), *columns], names=schema.names)
                    at = max(end, 1)

    return with_text(df, keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the decoded text of an ids column; null or empty ids give an empty text. A column named like it is replaced."""

    @F.pandas_udf("string")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(Model(model_path))
        for batch in batches:
            lists = [x if x is not None else np.zeros(0, np.int64) for x in batch]
            edges = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            yield pd.Series(decoder.decode(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64), edges), dtype=object)

    return df.withColumn(into, joined(F.col(f"`{ids}`")))
