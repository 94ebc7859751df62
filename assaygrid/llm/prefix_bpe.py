"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Of every prefix of a piece one number is stored: the last token of the prefix's encoding. That token is the only
one that ends the prefix and stands rightly after the last token of the shorter prefix before it; two tokens stand
rightly side by side if encoding their bytes gives the two again, and a sequence of such neighbours is the encoding
of its bytes. So a prefix is never looked at again: bytes that are appended extend the array, and after an edit the
array is right again as soon as it agrees with the old one over the length of the longest token.

Whether two tokens stand rightly is read off their merge trees: a merge across the border happens if its rank comes
before the one that takes away either of its parts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, without
from assaygrid.llm.token_count import _SPLIT, _WIDE_BYTES, pretokens

#: Pieces whose ids, and neighbours whose standing a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 400_000
_NEVER = 1 << 62


class Ranks:
    """A rank file (base64 of a token's bytes, its id; a line each): tokens, their merge trees, and who may stand after whom."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.index = {base64.b64decode(a): int(b) for a, b in pairs}
        if any(bytes([b]) not in self.index for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.tokens = {i: t for t, i in self.index.items()}
        self.longest = max(map(len, self.index))
        self.ends = ahocorasick.Automaton()
        for t, i in self.index.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        size = max(self.tokens) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            self.length[i] = len(t)
        self.size = self.length.tolist()
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)
        self._trees: dict[int, tuple[tuple[tuple[bytes, int], ...], tuple[tuple[bytes, int], ...]] | None] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    def merged(self, text: bytes, least: int = 1) -> list[int]:
        """Ids after merging the pair of lowest rank, leftmost first, until none is left or only least symbols are."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > least:
            rank, at = min((self.index.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.index[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from; itself twice for a byte; None if merging never gives it."""
        if token not in self._parts:
            text = self.tokens[token]
            if len(text) == 1:
                self._parts[token] = (token, token)
            else:
                two = self.merged(text, 2)
                self._parts[token] = (two[0], two[1]) if len(two) == 2 else None
        return self._parts[token]

    def spines(self, token: int):
        """What stands at a token's right and left border while it is merged: (bytes, rank that takes it away), innermost last.

        None where ranks fall on the way up, so that rank is not the order of merges.
        """
        if token not in self._trees:
            sides: list[list[tuple[bytes, int]]] = [[], []]
            good = self._rises(token)
            for side, out in zip((1, 0), sides, strict=True):
                at, until = token, _NEVER
                while good:
                    out.append((self.tokens[at], until))
                    if len(self.tokens[at]) == 1:
                        break
                    at, until = self.parts(at)[side], at  # type: ignore[index]
            self._trees[token] = (tuple(sides[0]), tuple(sides[1])) if good else None
        return self._trees[token]

    def _rises(self, token: int) -> bool:
        if len(self.tokens[token]) == 1:
            return True
        two = self.parts(token)
        return two is not None and max(self._order(p) for p in two) < token and all(self._rises(p) for p in two)

    def _order(self, token: int) -> int:
        """Rank of the merge that makes a token; bytes are there from the start."""
        return token if len(self.tokens[token]) > 1 else -1

    def follows(self, a: int, b: int) -> bool:
        """Whether b stands rightly after a: their bytes encode as the two."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            left, right = self.spines(a), self.spines(b)
            if left is None or right is None:
                known = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
            else:
                known = not self._crosses(left[0], right[1])
            self._fits[key] = known
        return known

    def _crosses(self, left: tuple[tuple[bytes, int], ...], right: tuple[tuple[bytes, int], ...]) -> bool:
        """Whether some merge across the border comes before its parts are taken away (of equal ranks the left one comes first)."""
        index = self.index
        for x, x_until in left:
            for y, y_until in right:
                rank = index.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return True
        return False

    def extend(self, text: bytes, last: list[int]) -> None:
        """Appends to last, which holds the last tokens of the first prefixes of text, those of the others."""
        done, fits = len(last), self._fits
        first = max(0, done - self.longest + 1)
        last.extend([-1] * (len(text) - done))
        for end, (token, size) in self.ends.iter(text[first:].decode("latin-1")):
            end += first
            if last[end] >= 0:
                continue
            before = end - size
            if before >= 0:
                fit = fits.get(last[before] << 32 | token)
                if fit or fit is None and self.follows(last[before], token):
                    last[end] = token
            elif self.parts(token) is not None:
                last[end] = token

    def ids(self, last: list[int]) -> list[int]:
        """The encoding that last tokens stand for, read from the end."""
        out, at, size = [], len(last), self.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece: a token of the vocabulary is itself, as the library has it."""
        whole = self.index.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.ids(last)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each has. Unknown ids raise."""
        if len(ids) and (int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.length[ids]
        return self.bytes[ragged.expand(self.start[ids], size)], size


class Prefixes:
    """A text with the last tokens of all its prefixes: exact ids after appends and edits, for the work of what changed.

    The text is cut into pieces by the pattern; a piece's last tokens are kept, and pieces before and after a change too.
    """

    def __init__(self, ranks: Ranks, text: str = ""):
        self.ranks, self.pieces, self.last = ranks, [], []
        self.work = 0  # prefixes computed so far
        self._splice(0, 0, text, [], [])

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        out: list[int] = []
        for piece, last in zip(self.pieces, self.last, strict=True):
            whole = self.ranks.index.get(piece.encode())
            out += [whole] if whole is not None else self.ranks.ids(last)
        return out

    def append(self, more: str) -> None:
        # a piece depends on what follows it by at most the two characters of 're, 've, 'll
        kept = max(0, len(self.pieces) - 2)
        self._splice(kept, len(self.pieces), "".join(self.pieces[kept:]) + more, self.pieces[kept:], self.last[kept:])

    def replace(self, begin: int, end: int, by: str) -> None:
        """Puts by in the place of the characters from begin to end."""
        ends = np.cumsum([len(p) for p in self.pieces])
        first = max(0, int(np.searchsorted(ends, begin, "right")) - 2)
        start = int(ends[first - 1]) if first else 0
        # cut anew until a cut of the old text is met again beyond the edit
        old_cuts = {int(e): i + 1 for i, e in enumerate(ends.tolist()) if e >= end}
        text, shift = self.text, len(by) - (end - begin)
        now = text[:begin] + by + text[end:]
        at, to = start, len(self.pieces)
        for m in _SPLIT.finditer(now, start):
            at = m.end()
            if at - shift in old_cuts and at >= begin + len(by):
                to = old_cuts[at - shift]
                break
        else:
            at = len(now)
        self._splice(first, to, now[start:at], self.pieces[first:to], self.last[first:to])

    def _splice(self, first: int, to: int, text: str, old: list[str], old_last: list[list[int]]) -> None:
        # text ends where a piece of the whole does, but the pattern looks one character beyond: it is cut with what follows
        follow = self.pieces[to][:1] if to < len(self.pieces) else ""
        fresh: list[str] = []
        for m in _SPLIT.finditer(text + follow):
            if m.start() >= len(text):
                break
            fresh.append(text[m.start() : m.end()])
        last = []
        for k, piece in enumerate(fresh):
            before = (old[k], old_last[k]) if k < len(old) else (old[-1], old_last[-1]) if old else ("", [])
            after = (old[k - len(fresh)], old_last[k - len(fresh)]) if len(fresh) - k <= len(old) else before
            last.append(self._relast(piece.encode(), before, after))
        self.pieces[first:to], self.last[first:to] = fresh, last

    def _relast(self, text: bytes, before: tuple[str, list[int]], after: tuple[str, list[int]]) -> list[int]:
        """Last tokens of a piece: those of the prefix it shares with one old piece, computed ones, and those of another's tail
        from where as many as the longest token has agree with it."""
        ranks, head = self.ranks, before[0].encode()
        same = 0
        while same < min(len(head), len(text)) and head[same] == text[same]:
            same += 1
        out, tail, old = before[1][:same], after[0].encode(), after[1]
        while len(out) < len(text):
            step = min(len(text), len(out) + ranks.longest)
            self.work += step - len(out)
            ranks.extend(text[:step], out)
            back = len(text) - step  # bytes still to come; the same ones must end the old piece
            at = len(tail) - back
            if back and at >= ranks.longest <= len(out) and tail[at - ranks.longest :] == text[step - ranks.longest :] and old[at - ranks.longest : at] == out[-ranks.longest :]:
                out = out + old[at:]
        return out


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    """The ranks of a file, read once a worker."""
    return Ranks(path)


class Encoder:
    """Ids of whole columns of texts; equal pieces are encoded once."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.known: dict[bytes, bytes] = {}

    def _pieces(self, unit: bytes) -> bytes:
        """Packed ids of a unit that the pattern may cut further."""
        return b"".join(self._packed(p.encode()) for p in _SPLIT.findall(unit.decode("utf-8", "replace")))

    def _packed(self, piece: bytes) -> bytes:
        out = self.known.get(piece)
        if out is None:
            ids = self.ranks.encode(piece)
            out = self.known[piece] = pack(f"<{len(ids)}I", *ids)
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of rows, and how many each row has."""
        starts, ends, single = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        h = ragged.hashes(data, starts, ends)
        h = np.where(single, h, ragged.mixed(h + np.uint64(1)))  # the same bytes may be a piece here and be cut there
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        packed = list(map(self.known.get, units))
        whole = single[at]
        for k in np.flatnonzero(~whole | np.fromiter((p is None for p in packed), bool, len(packed))).tolist():
            packed[k] = self._packed(units[k]) if whole[k] else self._pieces(units[k])
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), "<u4")
        ids = flat[ragged.expand((np.cumsum(sizes) - sizes)[back], sizes[back])]
        return ids, np.bincount(ragged.row_of(starts, offsets), sizes[back], len(offsets) - 1).astype(np.int64)

    def column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each row has) of slices of the column, in order."""
        for a, b, data, offsets in ragged.slices(column):
            ids, sizes = self.rows(data, offsets)
            raw = data.tobytes()
            if _WIDE_BYTES.search(raw):  # white space that bytes do not tell: such rows are cut by the pattern as a whole
                ends = np.cumsum(sizes)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                for i in range(b - a):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if _WIDE_BYTES.search(text):
                        each[i] = np.frombuffer(self._pieces(text), "<u4")
                        sizes[i] = len(each[i])
                ids = np.concatenate(each)
            yield ids, sizes


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker; what it remembers serves later tasks too."""
    return Encoder(path)


def _binary(chunks: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    """A binary column of chunks' bytes, cut at sizes (bytes a row)."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    flat = np.concatenate(chunks) if chunks else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def encode_texts(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit numbers) and n_tokens of the whole text.

    ranks: path of a rank file that every worker can read. Special strings inside texts are ordinary text.
    Null and empty texts: no ids (an empty binary), 0 tokens. Repeated rows: each is encoded. Columns of docs
    named ids or n_tokens are replaced. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    base = without(docs, "ids", "n_tokens")
    schema = base.select("*", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens")).schema

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks)
        for batch in batches:
            found = list(encoder.column(batch.column(batch.schema.get_field_index(text))))
            sizes = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
            ids = _binary([i.view(np.uint8) for i, _ in found], 4 * sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(sizes)], [*batch.schema.names, "ids", "n_tokens"])

    return base.mapInArrow(encoded, schema)


def decode_ids(df: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes that the ids of each row stand for; a null has none, an unknown id raises.

    A column of df named decoded is replaced.
    """
    arrow_batches(df.sparkSession)
    base = without(df, "decoded")
    schema = base.select("*", F.lit(b"").alias("decoded")).schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks_of(ranks)
        for batch in batches:
            chunks, sizes = [], []
            for _, _, data, offsets in ragged.slices(batch.column(batch.schema.get_field_index(ids))):
                out, size = table.decode(data.view("<u4"))
                chunks.append(out)
                sizes.append(np.diff(np.append(0, np.cumsum(size))[offsets // 4]))
            column = _binary(chunks, np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])

    return base.mapInArrow(decoded, schema)
