"""SimHash near-dedup: a generalised pigeonhole join of 64-bit fingerprints.

Bits are put in partitions, correlated ones together, and each partition gets its own threshold:
if thresholds t_i of -1 or more sum to k - m + 1 over m partitions, two fingerprints at distance k or less
agree to t_i or fewer bits in some partition i. Partitions and thresholds are chosen by dynamic
programming on the estimated number of candidates and probes, from bit counts and pair counts over all
fingerprints. A fingerprint lies in the index under its own bits of each partition and probes every value
within the threshold; what meets is verified on all bits.

Fingerprints are joined once each, however many texts have them. A bucket is cut into tiles, so no
task holds an unbounded one, and a task passes on a forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm import ragged
from assaygrid.llm.components import components, local_forest
from assaygrid.llm.tables import arrow_batches, without, written
from assaygrid.llm.tiles import deal, grouped

BITS = 64
#: Fingerprints of a bucket that a task holds at a time.
TILE = 4096

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text's words; of all its words if they are fewer; none of no words."""
    found = text.translate(_FOLD).split()  # bytes.split() parts at blanks and 0x09 to 0x0D
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.append(0, ends[: n - 1] + 1)
    stops = ends[len(ends) - n :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64, n)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs with fingerprint (long): bit i is set if it is in over half of the hashes of the text's shingles.

    Words: runs of anything but blanks and 0x09 to 0x0D, A-Z lower-cased; shingles: shingle words, repeats
    included. Texts without words (null, empty, blank): fingerprint 0.
    """
    arrow_batches(docs.sparkSession)
    base = without(docs, "fingerprint")
    schema = T.StructType([*base.schema, T.StructField("fingerprint", T.LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b, data, offsets in ragged.slices(batch.column(batch.schema.get_field_index(text)), 1 << 19):
                raw = data.tobytes()
                parts = [_hashes(raw[offsets[i] : offsets[i + 1]], shingle, seed) for i in range(b - a)]
                sizes = np.fromiter(map(len, parts), np.int64, b - a)
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                bits = np.unpackbits(np.concatenate(parts).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                heads = (np.cumsum(sizes) - sizes)[some]
                over = 2 * np.add.reduceat(bits, heads, axis=0, dtype=np.int64) > sizes[some, None]
                out[a + some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "fingerprint"])

    return base.mapInArrow(made, schema)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set (64 x 64), over all of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            f = np.asarray(batch.column(0)).view(np.uint64)
            bits = np.unpackbits(f.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(f)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n))], ["at", "n"])

    rows = prints.select("fingerprint").mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of equal size, correlated ones together: each part grows by the bit most like its own."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free = set(range(BITS))
    out = []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        ids = sorted(free)
        part = [max(ids, key=lambda i: (like[i, ids].sum(), -i))]
        free.discard(part[0])
        while len(part) < size:
            best = max(sorted(free), key=lambda i: like[i, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def within(n: int, both: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1 ... most bits of a part.

    As if bits were independent, of as many effective bits as the part's correlations leave.
    """
    p = np.diag(both)[part] / max(n, 1)
    q = np.clip(2 * p * (1 - p), 1e-6, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    sub = both[np.ix_(part, part)] / max(n, 1)
    r = np.abs((sub - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 1)
    effective = len(part) ** 2 / max((r**2).sum(), 1e-9)
    dist = np.zeros(len(part) + 1)
    dist[0] = 1
    for x in q:
        dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
        dist[0] *= 1 - x
    return np.cumsum(dist)[: most + 1] ** min(1.0, effective / len(part))


def allocate(n: int, both: np.ndarray, k: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds: the least estimated cost over numbers of partitions, by dynamic programming.

    A partition of threshold t costs n * probes(t) rows and n * n / 2 * share(t) candidates; -1 leaves it out.
    """
    best, least = [], math.inf
    for m in range(2, k + 2):
        parts = group_bits(n, both, m)
        goal = k - m + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            share = within(n, both, part, k)
            following: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in state.items():
                for t in range(-1, k + 1):
                    price = 0.0
                    if t >= 0:
                        probes = sum(math.comb(len(part), i) for i in range(t + 1))
                        price = n * (1 + probes) + 0.01 * n * n * share[t]
                    old = following.get(total + t)
                    if old is None or cost + price < old[0]:
                        following[total + t] = (cost + price, [*chosen, t])
            state = following
        if goal in state and state[goal][0] < least:
            least, best = state[goal][0], list(zip(parts, state[goal][1], strict=True))
    return [(part, t) for part, t in best if t >= 0]


def _value(f: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(f), np.uint64)
    for j, b in enumerate(part):
        out |= (f >> np.uint64(b) & np.uint64(1)) << np.uint64(j)
    return out


def _keys(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """fingerprint under each key: bucket (a partition's value, mixed with its number) and own (not a probe)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.asarray(batch.column(0)).view(np.uint64)
            for number, (part, t) in enumerate(plan):
                value = _value(f, part)
                for flips in (c for i in range(t + 1) for c in combinations(range(len(part)), i)):
                    mask = np.uint64(sum(1 << j for j in flips))
                    bucket = ragged.mixed((value ^ mask) * np.uint64(8) + np.uint64(number))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(len(f), not flips))], ["bucket", "fingerprint", "own"])

    return prints.select("fingerprint").mapInArrow(made, "bucket long, fingerprint long, own boolean")


def _links(keyed: DataFrame, k: int) -> DataFrame:
    """a, b: a forest of the links found in each tile of each bucket."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads, owns in grouped(batches):
            yield found(table["fingerprint"].to_numpy().view(np.uint64), heads, owns)

    def found(f: np.ndarray, heads: np.ndarray, owns: np.ndarray) -> pa.RecordBatch:
        ends = np.append(heads[1:], len(f))
        left, right = [], []
        small = ends - heads <= 64
        # all small groups at once: each own row with each other row of its group
        own_at = ragged.expand(heads[small], owns[small])
        others = np.repeat((ends - heads - owns)[small], owns[small])
        at = np.repeat((heads + owns)[small], owns[small])
        for i in range(0, len(own_at), 20_000):
            x = np.repeat(own_at[i : i + 20_000], others[i : i + 20_000])
            y = ragged.expand(at[i : i + 20_000], others[i : i + 20_000])
            near = np.bitwise_count(f[x] ^ f[y]) <= k
            near &= f[x] != f[y]
            left.append(f[x[near]])
            right.append(f[y[near]])
        for h, o, e in zip(heads[~small].tolist(), owns[~small].tolist(), ends[~small].tolist(), strict=True):
            group, back = np.unique(f[h:e], return_inverse=True)
            root = np.arange(len(group))
            for i in range(0, o, 256):
                x = back[i : min(i + 256, o)]
                near = np.bitwise_count(group[x][:, None] ^ f[h + o : e][None, :]) <= k
                p, q = np.nonzero(near)
                # links so far stand for their roots, so that no more than a forest is kept
                root = _joined(root, x[p], back[o:][q])
            ids = np.flatnonzero(root != np.arange(len(group)))
            left.append(group[ids])
            right.append(group[root[ids]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

    return deal(keyed, "fingerprint", TILE).mapInArrow(joined, "a long, b long")


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.unique(root[a] * len(root) + root[b])
    step = local_forest(len(root), pairs // len(root), pairs % len(root))
    return step[root]


def fingerprint_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of each row: the least doc_id that links of distance or fewer differing bits reach.

    Every text takes part: null, empty and blank ones have fingerprint 0 and link as any other. Rows with
    a null doc_id link too, but a component's id is the least that is not null (null if there is none);
    repeated rows are each returned. An empty table gives an empty result.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept, _ = written(fingerprints(named, "text", shingle, seed).select("doc_id", "fingerprint"), "fingerprints")
    groups = components_of(kept, distance)
    return kept.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs without near duplicates: of each component of fingerprint_components, the rows of its least doc_id.

    Rows with a null doc_id are kept as they are. A kept row keeps all its columns, of any name.
    """
    found = fingerprint_components(docs, text, doc_id, distance, shingle, seed)
    dropped = found.where("doc_id != component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[doc_id] == dropped["_dropped"], "left_anti")


def components_of(kept: DataFrame, distance: int) -> DataFrame:
    """fingerprint, component_id of written (doc_id, fingerprint) rows."""
    prints, _ = written(kept.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    n, both = bit_statistics(prints)
    plan = allocate(max(n, 2), both, distance)
    reached = components(_links(_keys(prints, plan), distance))
    rooted = prints.join(reached, prints["fingerprint"] == reached["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted, _ = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fingerprint", "component_id")
