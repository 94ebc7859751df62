"""Token counts: byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of a slice of rows are found on its bytes, equal ones are joined by hash, and those not
counted before are held as one ragged array of symbols. A round finds each sequence's lowest-rank
pair, merges all its occurrences from the left at once over the whole array, and drops what was
merged away; the rounds end when no sequence has a pair of the merge list. What is left of a
sequence is its number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, without

#: Fixed value: the split pattern of byte-level BPE files, as public_tokenizers.PATTERN gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
#: Pre-tokens whose counts a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 400_000

_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b"\t\n\v\f\r ")] = _SPACE
_KIND[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_KIND[list(range(48, 58))] = _DIGIT
_KIND[list(range(0, 9)) + list(range(14, 32)) + [127] + list(range(128, 256))] = _ODD
_KIND[ord("'")] = _ODD
#: White space outside ASCII (fixed values); rows that hold any are split by the pattern as a whole.
_WIDE_BYTES = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Second bytes after C3 that make a letter of U+00C0 to U+00FF.
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def byte_letters() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge list as sorted pair keys: rank and merged symbol of a pair, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order, made[order]
        letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), self.made[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done = lengths.copy()
        never = np.iinfo(np.int64).max
        while len(symbols):
            if len(symbols) == 1:
                done[owner[0]] = 1
                break
            rank, made = self.rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = never
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(np.append(rank, never), heads)
            sizes = np.diff(np.append(heads, len(owner)))
            alive = best < never
            done[owner[heads]] = sizes
            if not alive.any():
                break
            pick = np.append(rank, never) == np.repeat(np.where(alive, best, -1), sizes)
            # of overlapping occurrences (a a a) the left ones go first: every other one of a run
            at = np.flatnonzero(pick)
            fresh = np.append(True, at[1:] != at[:-1] + 1)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = made[at]
            keep = np.repeat(alive, sizes)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and whether a unit is a single pre-token.

    Units are pre-tokens where the bytes tell (ASCII without apostrophe, letters of U+00C0 to U+00FF);
    elsewhere a unit is everything between white space, with the blank before it, to be split by the pattern.
    """
    kinds = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_AFTER_C3[data[lead + 1]]]
    kinds[lead] = _LETTER
    kinds[lead + 1] = _LETTER
    # a stretch between white space that holds anything odd stays in one piece
    blank = (kinds == _SPACE).astype(np.uint8)
    s, e, k = ragged.runs(blank, offsets)
    if len(s):
        odd = np.maximum.reduceat(kinds, s) == _ODD
        where = odd & (k == 0)
        for_odd = ragged.expand(s[where], (e - s)[where])
        kinds[for_odd] = _ODD
    s, e, k = ragged.runs(kinds, offsets)
    n = len(s)
    if not n:
        return s, e, np.zeros(0, bool)
    space = k == _SPACE
    row = ragged.row_of(s, offsets)
    follows = np.append(space[1:] & False, False)
    follows[:-1] = (row[1:] == row[:-1]) & space[:-1]
    # white space before something: its last byte is a unit of its own, or goes to what follows if it is a blank
    head = np.flatnonzero(follows)
    last = data[e[head] - 1] == 32
    s2, e2 = s.copy(), e.copy()
    e2[head] -= 1
    s2[head[last] + 1] -= 1
    extra_s, extra_e = e2[head[~last]], e2[head[~last]] + 1
    keep = e2 > s2
    starts = np.concatenate([s2[keep], extra_s])
    ends = np.concatenate([e2[keep], extra_e])
    single = np.concatenate([k[keep] != _ODD, np.ones(len(extra_s), bool)])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], single[order]


class Counter:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes], single: np.ndarray) -> np.ndarray:
        """Tokens of each unit."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [w for w in words if w not in known]
        if fresh:
            alone = {w for w, s in zip(words, single.tolist(), strict=True) if s}
            parts = [[w] if w in alone else [p.encode() for p in _SPLIT.findall(w.decode("utf-8", "replace"))] for w in fresh]
            pieces = list(dict.fromkeys(p for ps in parts for p in ps if p not in known))
            if pieces:
                known.update(zip(pieces, self.merges.count(pieces).tolist(), strict=True))
            for w, ps in zip(fresh, parts, strict=True):
                known[w] = sum(known[p] for p in ps)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice without special strings."""
        rows = len(offsets) - 1
        starts, ends, single = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(rows, np.int64)
        h = ragged.hashes(data, starts, ends)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        tokens = self.words([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], single[at])[back]
        return np.bincount(ragged.row_of(starts, offsets), tokens, rows).astype(np.int64)

    def split(self, text: bytes) -> int:
        """Tokens of a text that holds no special string, split by the pattern."""
        parts = [p.encode() for p in _SPLIT.findall(text.decode("utf-8", "replace"))]
        return int(self.words(parts, np.ones(len(parts), bool)).sum())

    def column(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text. A special token's string inside a text is one token, as the library has it by default."""
        out = np.zeros(len(column), np.int64)
        rx = regex.compile("|".join(map(regex.escape, self.merges.specials)).encode()) if self.merges.specials else None
        for a, b, data, offsets in ragged.slices(column):
            out[a:b] = self.plain(data, offsets)
            raw = data.tobytes()
            special, wide = rx is not None and rx.search(raw), _WIDE_BYTES.search(raw)
            if special or wide:
                for i in range(b - a):
                    text = raw[offsets[i] : offsets[i + 1]]
                    found = rx.findall(text) if special else []
                    if found or wide and _WIDE_BYTES.search(text):
                        out[a + i] = len(found) + sum(self.split(p) for p in (rx.split(text) if found else [text]))
        return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of the whole text.

    tokenizer: path of a byte-level BPE tokenizer.json that every worker can read.
    Null and empty texts: 0 bytes, 0 tokens, not over the limit. Repeated rows: each is counted.
    Columns of docs named as a result's are replaced. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    base = without(docs, "n_bytes", "n_tokens", "over_limit")
    schema = base.select("*", F.lit(0).cast("long").alias("n_tokens")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            n = counter.column(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], [*batch.schema.names, "n_tokens"])

    return base.mapInArrow(counted, schema).select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
