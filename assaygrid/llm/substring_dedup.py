"""Substring dedup: hashing of lines, and of pieces of lines, grouped globally.

A text's words (ASCII letters and digits, A-Z lower-cased, and anything outside ASCII) are its
normal form. Units are of two levels. The first is the line: its digest is of its words, and every
later copy of a line goes. The second is for passages pasted into the middle of lines, which no hash
of whole lines can see: pieces that begin where the words themselves say so (where a hash of three
words falls into one of some classes or is the least around), so a passage is cut alike wherever it
stands. A piece's digest also covers the two words after it, so that none is shorter than three words.

A first pass over the texts gives each digest's earliest occurrence in a slice (what a slice repeats
it flags at once). What a slice repeats is remembered by its task, which flags it in later slices too where an
earlier ranked one has gone by: so a very frequent unit leaves a few rows a task, not one a slice or an occurrence. One shuffle
by digest then flags all but the earliest ranked. A flagged line is cut out of the text, and a run of
flagged pieces of at least min_words words; the spans kept are of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, without

#: A unit begins at one in so many words.
UNIT_WORDS = 4
#: Words of the context that decides where a unit begins.
CONTEXT = 3
#: The places of lines begin here, so that they are told from those of pieces.
LINES = 1 << 30
#: Digests that a task remembers, those that a slice repeated.
FREQUENT = 200_000
#: A word whose context hash is the least of so many before and after begins a unit too.
REACH = 12

_LINE = np.uint64(0x5851F42D4C957F2D)
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lowest(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether none of the REACH before and after in the row is lower: so one begins within any 2 * REACH + 1, periodic texts too."""
    n = len(h)
    if not n:
        return np.zeros(0, bool)
    at = np.arange(n) + (row + 1) * REACH
    padded = np.full(int(at[-1]) + 2 * REACH + 1, np.iinfo(np.uint64).max, np.uint64)
    padded[at] = h
    low, width = padded, 1
    while width < REACH + 1:  # low[i]: the least of width from i on
        step = min(width, REACH + 1 - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return (h <= low[at]) & (h <= low[at - REACH])


class Units:
    """The words and units of the rows of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data, self.offsets = _LOWER[data], offsets
        s, e, k = ragged.runs(_WORD[data], offsets)
        self.start, self.end = s[k == 1], e[k == 1]
        row = ragged.row_of(self.start, offsets)
        n = len(row)
        self.words = np.bincount(row, minlength=len(offsets) - 1)
        self.word_ends = np.cumsum(self.words)
        word = ragged.hashes(data, self.start, self.end) if n else np.zeros(0, np.uint64)
        last = self.word_ends[row]  # the word after the row's last
        at = np.arange(n)
        first = np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        context = ragged.span_hashes(word, at, np.minimum(at + CONTEXT, last))
        begins = ((context % np.uint64(UNIT_WORDS) == 0) | _lowest(context, row)) & (at + CONTEXT <= last) | first
        self.first = np.flatnonzero(begins)  # of words, by unit
        self.row = row[self.first]
        self.last = np.append(self.first[1:], n)
        reach = np.minimum(self.last + CONTEXT - 1, last[self.first]) if n else self.last
        self.digest = ragged.span_hashes(word, self.first, reach)
        # where a row's units begin
        self.head = np.searchsorted(self.row, np.arange(len(offsets)))
        # a line begins at a row's first word and at each first word after a line end
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, self.start)
        fresh = first.copy()
        fresh[1:] |= line[1:] != line[:-1]
        self.line_first = np.flatnonzero(fresh)  # of words, by line
        self.line_row = row[self.line_first]
        self.line_last = np.append(self.line_first[1:], n)
        self.line_digest = ragged.mixed(ragged.span_hashes(word, self.line_first, self.line_last) ^ _LINE)
        self.line_head = np.searchsorted(self.line_row, np.arange(len(offsets)))
        # the byte after the line end before it, or where its row begins
        before = line[self.line_first] - 1
        begin = np.where(before >= 0, ends[before] + 1, 0) if len(ends) else np.zeros(len(before), np.int64)
        self.line_start = np.maximum(begin, offsets[self.line_row])


    def pieces_at(self, row: int, at: np.ndarray, least: int) -> np.ndarray:
        """First word, word after the last, first byte, byte after the last of each run of pieces at these places of a row, of least words or more."""
        at = at[at < self.head[row + 1] - self.head[row]]
        if not len(at):
            return np.zeros((0, 4), np.int64)
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        tails = np.append(heads[1:], len(at)) - 1
        first, last = self.first[self.head[row] + at[heads]], self.last[self.head[row] + at[tails]]
        long = last - first >= least
        first, last = first[long], last[long]
        end = self.offsets[row + 1]
        return np.stack([first, last, self.start[first], np.where(last < self.word_ends[row], np.append(self.start, end)[last], end)], 1)

    def lines_at(self, row: int, at: np.ndarray, least: int) -> np.ndarray:
        """The same of each line."""
        at = self.line_head[row] + at[at < self.line_head[row + 1] - self.line_head[row]]
        at = at[self.line_last[at] - self.line_first[at] >= least]
        end = self.offsets[row + 1]
        return np.stack([self.line_first[at], self.line_last[at], self.line_start[at], np.where(at + 1 < self.line_head[row + 1], np.append(self.line_start, end)[at + 1], end)], 1)


def copy_of(text: str):
    """Tells rows of one doc_id apart by their texts: 30 bits of a hash, as many as a row's number has room for."""
    return F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(2**30)).cast("int")


class Frequent:
    """Of digests that some slice of a task repeated, the earliest rank that has gone by."""

    def __init__(self) -> None:
        self.least: dict[int, tuple] = {}
        self.known = np.zeros(0, np.uint64)

    def later(self, digests: np.ndarray, rank_of) -> np.ndarray:
        """Places of digests that have an earlier rank than theirs; the ranks of others are remembered. digests: sorted, once each."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.known, digests)
        hit = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == digests)
        out = []
        for k in hit.tolist():
            d, rank = int(digests[k]), rank_of(k)
            if self.least[d] < rank:
                out.append(k)
            else:
                self.least[d] = rank
        return np.array(out, np.int64)

    def add(self, digests: np.ndarray, places: np.ndarray, rank_of) -> None:
        """Remembers digests (at these places of the slice's) that it did not, as many as there is room for."""
        fresh = [(int(d), k) for d, k in zip(digests.tolist(), places.tolist(), strict=True) if d not in self.least][: FREQUENT - len(self.least)]
        if fresh:
            self.least |= {d: rank_of(k) for d, k in fresh}
            self.known = np.sort(np.fromiter(self.least, np.uint64, len(self.least)))


def units(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, spot, digest. Rows of one digest: at most one a slice, a few a task if it is frequent, and those that are repeated (any digest).

    spot holds copy, unit (its place) and repeated in one number, in this order, as each row is shuffled.
    """
    arrow_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("spot", T.LongType()), T.StructField("digest", T.LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent()
        for batch in batches:
            # rank order inside the slice, so that its first occurrence is the earliest ranked
            batch = batch.sort_by([("doc_id", "ascending"), ("copy", "ascending")])
            ids, copies = batch.column(0), batch.column(1)
            # rows of equal doc_id and copy are one document
            same = pc.and_(pc.equal(ids[1:], ids[:-1]), pc.equal(copies[1:], copies[:-1])).to_numpy(zero_copy_only=False)
            document = np.cumsum(np.append(0, ~same.astype(bool)))
            for a, b, data, offsets in ragged.slices(batch.column(2)):
                u = Units(data, offsets)
                row, own = np.append(u.row, u.line_row), np.append(u.digest, u.line_digest)
                place = np.append(np.arange(len(u.row)) - u.head[u.row], np.arange(len(u.line_row)) - u.line_head[u.line_row] + LINES).astype(np.int32)
                found = np.arange(len(row))
                if document[a] + b - a - 1 > document[b - 1]:  # a document stands here twice: each of its units counts once
                    of = np.stack([document[a + row], place, own.view(np.int64)])
                    found = np.sort(np.unique(of, axis=1, return_index=True)[1])
                    found = found[np.lexsort((place[found], document[a + row[found]]))]
                digests, first, times = np.unique(own[found], return_index=True, return_counts=True)
                repeated = np.ones(len(found), bool)
                repeated[first] = False
                place, row, own = place[found], row[found], own[found]

                def rank_of(k: int, a=a, row=row, place=place, first=first) -> tuple:
                    i = a + int(row[first[k]])
                    return ids[i].as_py(), copies[i].as_py(), int(place[first[k]])

                repeated[first[frequent.later(digests, rank_of)]] = True
                twice = np.flatnonzero(times > 1)
                frequent.add(digests[twice], twice, rank_of)
                # a flagged row needs no group: any digest does, and its own spreads them no worse than others
                digest = np.where(repeated, ragged.mixed(own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64)), own)
                spot = copies.to_numpy()[a + row].astype(np.int64) * (1 << 33) + place.astype(np.int64) * 2 + repeated
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + row)), pa.array(spot), pa.array(digest.view(np.int64))], schema.names)

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), copy_of(text).alias("copy"), F.col(text).alias("text")).mapInArrow(made, schema)


def flagged(found: DataFrame) -> DataFrame:
    """doc_id, copy, units: the places of units that an earlier ranked text, or an earlier place, has.

    A window holds a digest's rows, of a frequent one a few for each task that read texts, and spills them to disk beyond some thousands.
    """
    rank, repeated = F.struct("doc_id", "spot"), F.col("spot").bitwiseAND(F.lit(1)) == 1
    earliest = F.min(F.when(~repeated, rank)).over(Window.partitionBy("digest"))
    later = found.withColumn("earliest", earliest).where(repeated | (rank > F.col("earliest")))
    unit = F.shiftright(F.col("spot").bitwiseAND(F.lit((1 << 33) - 1)), 1).cast("int")
    return later.groupBy("doc_id", F.shiftright("spot", 33).cast("int").alias("copy")).agg(F.collect_set(unit).alias("units"))


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 25, min_line_words: int = 1) -> DataFrame:
    """docs with repeated passages cut out of text, n_words (before), n_removed (words) and removed.

    removed: array<struct<start int, end int>>, the spans cut, in code points of the original text.
    Of equal units, the one of the smallest doc_id, there the first, stays; any run of later ones
    of at least min_words words goes, whole with the white space and signs up to the next word; shorter
    runs stay. Of equal lines (by their words) of min_line_words words or more all but the first go as
    well, whatever min_words is, with their line ends and the lines without words that follow. A passage that two documents share is cut but for the pieces of units at its ends.
    Null texts stay null, empty ones empty; rows with a null doc_id are kept as they are and are not
    compared; rows that repeat a doc_id and its text are one document and lose the same, those of another
    text are documents of their own. Exact copies of a text of
    min_words words or more end up empty. Columns of docs named as a result's are replaced.
    """
    base = without(docs, "n_words", "n_removed", "removed", "_units", "_id", "_copy")
    flags = flagged(units(base, text, doc_id)).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("units").alias("_units"))
    both = base.join(flags, (base[doc_id] == flags["_id"]) & (copy_of(text) == flags["_copy"]), "left").drop("_id", "_copy")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*base.schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text)
            column = batch.column(where)
            lists = batch.column(batch.num_columns - 1)
            n_words = np.zeros(batch.num_rows, np.int64)
            n_removed = np.zeros(batch.num_rows, np.int64)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            changed: dict[int, str] = {}
            for a, b, data, offsets in ragged.slices(column):
                u = Units(data, offsets)
                n_words[a:b] = u.words
                for i in range(a, b):
                    if not lists[i].is_valid:
                        continue
                    at = np.sort(np.array(lists[i].as_py(), np.int64))
                    found = [x for x in (u.pieces_at(i - a, at[at < LINES], min_words), u.lines_at(i - a, at[at >= LINES] - LINES, min_line_words)) if len(x)]
                    if not found:
                        continue
                    first, last, x, y = np.concatenate(found).T
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], np.maximum.accumulate(y[order])
                    heads = np.flatnonzero(np.append(True, x[1:] > y[:-1]))
                    gone = np.zeros(int(last.max() - first.min()), bool)
                    gone[ragged.expand(first - first.min(), last - first)] = True
                    n_removed[i] = gone.sum()
                    raw = data[offsets[i - a] : offsets[i - a + 1]].tobytes()
                    kept, done, points = [], 0, 0
                    for x, y in zip((x[heads] - offsets[i - a]).tolist(), (y[np.append(heads[1:], len(y)) - 1] - offsets[i - a]).tolist(), strict=True):
                        kept.append(raw[done:x])
                        s = points + len(raw[done:x].decode("utf-8", "replace"))
                        points = s + len(raw[x:y].decode("utf-8", "replace"))
                        spans[i].append({"start": s, "end": points})
                        done = y
                    kept.append(raw[done:])
                    changed[i] = b"".join(kept).decode("utf-8", "replace")
            if changed:
                texts = column.to_pylist()
                for i, x in changed.items():
                    texts[i] = x
                column = pa.array(texts, column.type)
            columns = [column if j == where else c for j, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*batch.schema.names[:-1], "n_words", "n_removed", "removed"])

    return both.mapInArrow(cut, schema)
