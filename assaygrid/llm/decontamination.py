"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is a run of consecutive words of a benchmark item and stands for the set of its short
shingles. Shingles are ordered by rarity, counted over all documents. A document that contains a
window holds all of its shingles, so at full containment the necessary prefix is one shingle: the
rarest. Documents are joined on it; the shingle's place in the window gives the window's place in
the document, where the bounds (it may not start before the text or end after it) and then the
words themselves are compared.

The index of a benchmark of any size is built in blocks of bounded bytes, each broadcast by itself;
a document carries its hits from block to block, so nothing is shuffled but the shingle counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, without, written

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 2 << 20
#: Blocks that are looked for in a row before what was found is written.
CHAIN = 4
SHINGLE = 3

#: A-Z in lower case; what is no word (ASCII other than letters and digits) becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and anything outside ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass
class Index:
    """Windows of one block of items. Windows of equal words are one; each knows its items."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # a row of word ids each, padded with -1
    lengths: np.ndarray
    window_items: list[list[str]]
    keys: dict[int, np.ndarray]  # by shingle size: sorted keys
    first_words: np.ndarray  # whether a word begins a shingle of the join
    # the join: by shingle (size, place in keys) the windows it stands for, and its place in them
    head: dict[int, np.ndarray]
    count: dict[int, np.ndarray]
    of_window: dict[int, np.ndarray]
    at: dict[int, np.ndarray]


def _key(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """A number for each shingle of a row of word ids (-1: not in the benchmark; such shingles get -1)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, good = ids[:n].astype(np.int64), ids[:n] >= 0
    for j in range(1, size):
        part = ids[j : j + n]
        key = key * base + part
        good &= part >= 0
    return np.where(good, key, -1)


class Block:
    """The words, windows and shingles of a block, before rarity is known."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), {})[item] = None
        self.sequences = list(found)
        self.items = [list(x) for x in found.values()]
        self.base = len(self.vocabulary) + 1
        self.shingles: dict[int, np.ndarray] = {}
        for size in range(1, SHINGLE + 1):
            keys = [_key(np.array(s), size, self.base) for s in self.sequences if min(len(s), SHINGLE) == size]
            if keys:
                self.shingles[size] = np.unique(np.concatenate(keys))

    def index(self, counts: dict[int, np.ndarray]) -> Index:
        """Each window under its rarest shingle; of equally rare ones, the smallest key, then the first place."""
        windows = np.full((len(self.sequences), max(map(len, self.sequences), default=1)), -1, np.int64)
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for w, sequence in enumerate(self.sequences):
            windows[w, : len(sequence)] = sequence
            size = min(len(sequence), SHINGLE)
            key = _key(np.array(sequence), size, self.base)
            place = np.searchsorted(self.shingles[size], key)
            best = np.lexsort((np.arange(len(key)), key, counts[size][place]))[0]
            rows.setdefault(size, []).append((int(key[best]), w, int(best)))
        out = Index(self.vocabulary, windows, np.array([len(s) for s in self.sequences], np.int64), self.items, {}, np.zeros(self.base, bool), {}, {}, {}, {})
        for size, found in rows.items():
            table = np.array(sorted(found), np.int64)
            out.keys[size], out.head[size], out.count[size] = np.unique(table[:, 0], return_index=True, return_counts=True)
            out.of_window[size], out.at[size] = table[:, 1], table[:, 2]
            out.first_words[out.keys[size] // self.base ** (size - 1)] = True
        return out


def _rows(column: pa.Array, vocabulary: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids of the slice's rows, each row's number of words)."""
    get = vocabulary.get
    for a, b, data, offsets in ragged.slices(column):
        raw = data.tobytes()
        split = [words(raw[offsets[i] : offsets[i + 1]]) for i in range(b - a)]
        sizes = np.fromiter(map(len, split), np.int64, b - a)
        ids = np.concatenate([np.fromiter(map(get, s, repeat(-1)), np.int64, len(s)) for s in split])
        yield a, ids, sizes


def _shingles(ids: np.ndarray, ends: np.ndarray, size: int, base: int) -> np.ndarray:
    """Shingle keys of a slice, none over a row's border (a row border is where a shingle would reach past an end)."""
    key = _key(ids, size, base)
    if size > 1 and len(key):
        cut = np.zeros(len(ids) + 1, bool)
        for j in range(1, size):
            cut[np.maximum(ends - j, 0)] = True
        cut = cut[: len(key)]
        # a row shorter than the shingle may have marked the row before it: those reach past its end anyway
        key[cut] = -1
    return key


def _counts(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of a block occurs in all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((block.vocabulary, block.shingles, block.base))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shingles, base = shared.value
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in shingles.items()}
        for batch in batches:
            for _, ids, sizes in _rows(batch.column(0), vocabulary):
                ends = np.cumsum(sizes)
                for size, keys in shingles.items():
                    key = _shingles(ids, ends, size, base)
                    key = key[key >= 0]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    totals[size] += np.bincount(at[keys[at] == key], minlength=len(keys))
        for size, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(total[at])], ["size", "at", "n"])

    found = docs.select(text).mapInArrow(counted, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    out = {size: np.zeros(len(keys), np.int64) for size, keys in block.shingles.items()}
    for r in found.toLocalIterator():  # a row per shingle of the block at most
        out[r["size"]][r["at"]] = r["n"]
    return out


def _find(index: Index, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a slice: their rows, starts and window numbers."""
    row, start, window = [], [], []
    base = len(index.vocabulary) + 1
    for size, keys in index.keys.items():
        at = np.flatnonzero(index.first_words[ids])  # -1 is the unused last place
        at = at[at + size <= len(ids)]
        key, good = ids[at], np.ones(len(at), bool)
        for j in range(1, size):
            good &= ids[at + j] >= 0
            key = key * base + ids[at + j]
        at, key = at[good], key[good]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[k] == key
        at, k = at[hit], k[hit]
        pairs = ragged.expand(index.head[size][k], index.count[size][k])
        w = index.of_window[size][pairs]
        s = np.repeat(at, index.count[size][k]) - index.at[size][pairs]
        # length and position: the whole window must lie in the row that holds the shingle
        r = np.repeat(np.searchsorted(ends, at, "right"), index.count[size][k])
        heads = np.append(0, ends[:-1])
        fits = (s >= heads[r]) & (s + index.lengths[w] <= ends[r])
        w, s, r = w[fits], s[fits], r[fits]
        same = np.ones(len(w), bool)
        for j in range(index.windows.shape[1]):
            inside = j < index.lengths[w]
            same &= ~inside | (ids[np.minimum(s + j, len(ids) - 1)] == index.windows[w, j])
        row.append(r[same])
        start.append(s[same])
        window.append(w[same])
    if not row:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(row), np.concatenate(start), np.concatenate(window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: float = 0.05
) -> DataFrame:
    """docs with n_words, n_hit, items and contaminated.

    n_words: words of the text; n_hit: words inside any occurrence of a window of the benchmark; items:
    array<string>, the items with a window in the text, sorted; contaminated: n_hit > 0 and n_hit at least
    share of n_words. A window is window consecutive words of an item; a shorter item is one window, one
    without words has none. Null texts have no words; null item ids count as the string "null"; equal
    items and repeated rows are each reported. Columns of docs named as a result's are replaced. Empty
    docs give an empty result; an empty benchmark gives no hits.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES)
    base = without(docs, "n_words", "n_hit", "items", "contaminated", "_hit", "_items")
    state = T.StructType([*base.schema, T.StructField("n_words", T.LongType()), T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
    current = base
    for b in range(max(1, blocks)):
        part = items if blocks <= 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        block = Block([(r["item"], (r["text"] or "").encode()) for r in part.toLocalIterator()], window)
        index = block.index(_counts(base, text, block) if block.shingles else {})
        current = current.mapInArrow(_scan(spark.sparkContext.broadcast(index), text, b == 0), state)
        if b % CHAIN == CHAIN - 1 and b < blocks - 1:  # each is a Python worker of the task
            current, _ = written(current, "scanned")
    hit = F.length(F.regexp_replace(F.hex("_hit"), "[^1]", ""))  # one byte 00 or 01 for each word
    out = current.select(
        *[F.col(f"`{c}`") for c in base.columns],
        "n_words",
        F.when(F.length("_hit") == 0, 0).otherwise(hit).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("_items")).alias("items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))


def _scan(shared, text: str, first: bool):
    """A pass over documents with one block's index; after the first, hits are added to those so far."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            if first:
                hits, items = [b""] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            else:
                hits, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for a, ids, sizes in _rows(batch.column(batch.schema.get_field_index(text)), index.vocabulary):
                n_words[a : a + len(sizes)] = sizes
                ends = np.cumsum(sizes)
                rows, starts, windows = _find(index, ids, ends)
                if not len(rows):
                    continue
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + index.lengths[windows], -1)
                inside = (np.cumsum(edge[:-1]) > 0).astype(np.uint8)
                for r, w in np.unique(np.stack([rows, windows], 1), axis=0).tolist():
                    items[a + r].extend(index.window_items[w])
                for r in np.unique(rows).tolist():
                    here = inside[ends[r] - sizes[r] : ends[r]]
                    if hits[a + r]:
                        here = here | np.frombuffer(hits[a + r], np.uint8)
                    hits[a + r] = here.tobytes()
                    items[a + r] = sorted(set(items[a + r]))
            columns = batch.columns if first else batch.columns[:-3]
            names = batch.schema.names if first else batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "_hit", "_items"]
            )

    return scanned
