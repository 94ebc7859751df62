"""Packing: minimum bin slack over remaining lengths.

A worker tokenizes a block of whole texts and packs it by itself, so tokens are never shuffled and
memory is bounded by the block. Texts longer than a window give full windows of their own; what
remains of each is a length below the window. For these lengths and their counts, a bitset
subset-sum dynamic programme finds the multiset that fills a window closest to capacity, with the
counts used traced back; the same multiset is used as often as the counts allow. Where the closest
fill leaves slack, the next length is cut to close it. The last tokens of a block, less than a
window, are cut at powers of two, lengths that need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches

#: Tokens that a worker holds before it packs them.
BLOCK_TOKENS = 4_000_000
#: Units of text whose ids a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 300_000

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b"\t\n\v\f\r ")] = _SPACE
_KIND[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_KIND[list(range(48, 58))] = _DIGIT
_KIND[list(range(0, 9)) + list(range(14, 32)) + [127] + list(range(128, 256))] = _ODD
_KIND[ord("'")] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_UPPER_C3 = np.zeros(256, bool)
_UPPER_C3[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


class Ids:
    """Token ids of texts, as the tokenizers library gives them, with the ids of equal units remembered.

    A unit is what lies between white space, cut further between letters, digits and other signs where
    it is plain (no apostrophe, control character or sign outside U+00C0 to U+00FF) and holds no special
    string. This holds for tokenizers that drop white space and split between those classes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, specials)).encode()) if specials else None
        self.forget()

    def forget(self) -> None:
        """Units are numbered; their ids lie one after the other in self.ids from self.heads on."""
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.heads = np.zeros(REMEMBERED + (1 << 19), np.int64)
        self.sizes = np.zeros(REMEMBERED + (1 << 19), np.int64)
        self.filled = 0

    def learn(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, end = len(self.known), self.filled + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.filled : end] = ids
        if at + len(units) > len(self.heads):
            self.heads, self.sizes = (np.resize(x, 2 * (at + len(units))) for x in (self.heads, self.sizes))
        self.sizes[at : at + len(units)] = sizes
        self.heads[at : at + len(units)] = self.filled + np.cumsum(sizes) - sizes
        self.filled = end
        self.known.update(zip(units, range(at, at + len(units)), strict=True))

    def look(self, units: list[bytes], plain: list[bool]) -> np.ndarray:
        """The numbers of units (all different)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        got = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(got < 0).tolist()
        if new:
            easy = [units[i] for i in new if plain[i]]
            # many plain units make one text, whose ids the ends of the units part again
            for i in range(0, len(easy), 2000):
                part = easy[i : i + 2000]
                found = self.library.encode(b" ".join(part).decode(), add_special_tokens=False)
                ends = np.fromiter((b for _, b in found.offsets), np.int64, len(found.ids))
                stops = np.cumsum([len(u.decode()) + 1 for u in part]) - 1
                self.learn(part, np.array(found.ids, np.uint32), np.diff(np.searchsorted(ends, stops, "right"), prepend=0))
            hard = [units[i] for i in new if not plain[i]]
            if hard:
                many = self.library.encode_batch([u.decode("utf-8", "replace") for u in hard], add_special_tokens=False)
                self.learn(hard, np.array([x for g in many for x in g.ids], np.uint32), np.array([len(g.ids) for g in many], np.int64))
            got[new] = [self.known[units[i]] for i in new]
        return got

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice in one array, and each row's number of them."""
        rows = len(offsets) - 1
        data = _LOWER[data]
        kinds = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        good = _AFTER_C3[after]
        data[lead[_UPPER_C3[after]] + 1] += 32
        kinds[lead[good]] = _LETTER
        kinds[lead[good] + 1] = _LETTER
        s, e, k = ragged.runs((kinds == _SPACE).astype(np.uint8), offsets)
        if len(s):
            odd = (np.maximum.reduceat(kinds, s) == _ODD) & (k == 0)
            kinds[ragged.expand(s[odd], (e - s)[odd])] = _ODD
        s, e, k = ragged.runs(kinds, offsets, alone=_DIGIT)
        keep = k != _SPACE
        s, e, k = s[keep], e[keep], k[keep]
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        h = ragged.hashes(data, s, e)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self.look([raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)], (k[at] != _ODD).tolist())
        sizes, heads = self.sizes[ids][back], self.heads[ids][back]
        return self.ids[ragged.expand(heads, sizes)], np.bincount(ragged.row_of(s, offsets), sizes, rows).astype(np.int64)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, ids of each row) by slices."""
        for a, b, data, offsets in ragged.slices(column):
            raw = data.tobytes()
            # what the library alone decides: special strings, and controls that Unicode doesn't call white space
            if not (self.special and self.special.search(raw)) and not _CONTROLS.search(raw):
                yield a, b, *self.slice(data, offsets)
                continue
            for i in range(b - a):
                text = raw[offsets[i] : offsets[i + 1]]
                if self.special and self.special.search(text) or _CONTROLS.search(text):
                    ids = np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                    yield a + i, a + i + 1, ids, np.array([len(ids)])
                else:
                    yield a + i, a + i + 1, *self.slice(data[offsets[i] : offsets[i + 1]], np.array([0, len(text)]))


_CONTROLS = re.compile(rb"[\x1c-\x1f]")


def closest_fill(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each length fill capacity closest from below: a bitset subset-sum with counts traced back.

    Bit t of reach[i] says that the first i parts can sum to t; a count c is dealt as parts of 1, 2, 4, ... and
    the rest times the length, so that every number up to c can be made.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, parts = [1], []
    for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        count, power = min(count, capacity // length), 1
        while count > 0:
            take = min(power, count)
            parts.append((length, take))
            reach.append((reach[-1] | reach[-1] << (length * take)) & mask)
            count -= take
            power *= 2
        if reach[-1] >> capacity & 1:
            break
    at, used = reach[-1].bit_length() - 1, {}
    for i in range(len(parts) - 1, -1, -1):
        if not reach[i] >> at & 1:
            length, take = parts[i]
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of the given lengths: document, start, length, sequence, offset.

    Every id lies in one piece; every sequence is full or, at the end, has a power of two of ids.
    """
    full = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    out = [[doc, start, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)]]
    sequence = len(doc)
    rest = lengths - full * capacity
    ids = np.flatnonzero(rest)
    order = ids[np.argsort(-rest[ids], kind="stable")]
    # stacks of (document, start) by length; what a cut leaves over goes on its length's stack
    stacks: dict[int, list[tuple[int, int]]] = {}
    for d in order[::-1].tolist():
        stacks.setdefault(int(rest[d]), []).append((d, int(full[d]) * capacity))
    pieces: list[tuple[int, int, int, int, int]] = []
    total = int(rest.sum())
    while total >= capacity:
        have = np.array(sorted(stacks, reverse=True), np.int64)
        counts = np.array([len(stacks[n]) for n in have.tolist()], np.int64)
        used = closest_fill(have, counts, capacity)
        filled = sum(n * c for n, c in used.items())
        times = min(len(stacks[n]) // c for n, c in used.items()) if filled == capacity else 1
        for _ in range(times):
            offset = 0
            for n, c in used.items():
                for _ in range(c):
                    d, s = stacks[n].pop()
                    pieces.append((d, s, n, sequence, offset))
                    offset += n
            while offset < capacity:  # cut what is shortest above the slack, else take what is there
                left = sorted(n for n, stack in stacks.items() if stack)
                n = next((n for n in left if n >= capacity - offset), left[-1])
                d, s = stacks[n].pop()
                take = min(n, capacity - offset)
                pieces.append((d, s, take, sequence, offset))
                offset += take
                if take < n:
                    stacks.setdefault(n - take, []).append((d, s + take))
            sequence += 1
            total -= capacity
        stacks = {n: stack for n, stack in stacks.items() if stack}
    offset, room = 0, 1 << (total.bit_length() - 1) if total else 0
    for length in sorted(stacks, reverse=True):
        for d, s in stacks[length]:
            n = length
            while n:
                take = min(n, room - offset)
                pieces.append((d, s, take, sequence, offset))
                offset, s, n, total = offset + take, s + take, n - take, total - take
                if offset == room:
                    sequence, offset = sequence + 1, 0
                    room = 1 << (total.bit_length() - 1) if total else 0
    out.append(list(np.array(pieces, np.int64).reshape(-1, 5).T))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most capacity ids: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ids_crc32: of the ids as little-endian unsigned 32-bit numbers; with_ids False leaves out ids.

    A document is its text's ids, then end_id. Sequences are full or have a power of two of ids, so none
    needs padding; few documents are cut but those longer than capacity. Null and empty texts: the end id
    alone. Repeated rows: each is packed. Null doc_ids are kept. Other columns of docs are dropped. An empty
    table gives an empty result. sequence_id: the number of the partition times 2**33, and a count there.
    tokenizer: path of a tokenizer.json that drops white space, which every worker can read.
    """
    arrow_batches(docs.sparkSession)
    base = docs.select(doc_id, text)
    schema = T.StructType(
        [T.StructField("doc_id", base.schema[0].dataType)]
        + [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), *[T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids]
        + [T.StructField(n, T.LongType()) for n in ("ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Ids(tokenizer)
        context = TaskContext.get()
        state = {"base": (context.partitionId() if context else 0) << 33}
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for a, b, got, n in coder.texts(batch.column(1)):
                # the end id after each row's ids
                at = np.cumsum(n)
                ids.append(np.insert(got, at, end_id).astype(np.int32))
                sizes.append(n + 1)
                names.append(batch.column(0).slice(a, b - a))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield from block(names, ids, sizes, state)
                    names, ids, sizes, held = [], [], [], 0
        if ids:
            yield from block(names, ids, sizes, state)

    def block(names: list[pa.Array], ids: list[np.ndarray], sizes: list[np.ndarray], state: dict) -> Iterator[pa.RecordBatch]:
        flat, n = np.concatenate(ids), np.concatenate(sizes)
        ids.clear()
        doc, start, length, sequence, offset = pack_lengths(n, capacity)
        order = np.lexsort((start, doc))
        doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
        who = pa.concat_arrays(names)
        head = np.cumsum(n) - n
        for i in range(0, len(doc), 2000):
            j = slice(i, i + 2000)
            first = int(head[doc[j][0]] + start[j][0])
            size = np.append(0, np.cumsum(length[j]))
            # sorted by document and start, pieces lie one after the other in flat
            here = flat[first : first + int(size[-1])].astype("<i4", copy=False)
            crc = [zlib.crc32(here[a:b]) for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            tokens = [pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(here))] * with_ids
            yield pa.RecordBatch.from_arrays(
                [who.take(pa.array(doc[j])), pa.array(start[j]), pa.array(length[j]), *tokens, pa.array(crc, pa.int64()), pa.array(n[doc[j]]), pa.array(sequence[j] + state["base"]), pa.array(offset[j])],
                names=schema.names,
            )
        state["base"] += int(sequence.max()) + 1 if len(sequence) else 0

    return base.mapInArrow(packed, schema)
