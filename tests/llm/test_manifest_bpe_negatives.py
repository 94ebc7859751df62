"""The manifest, the prefix encoder and the hard negatives against brute force, and on odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from assaygrid.llm import hard_negatives, merkle, prefix_bpe, queries

SF = "/root/testdata/sf0.001"
RANKS = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, source string, lang string, n_chars long, text string, LEAF string, ids string, key string, decoded string"


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and long texts, repeated rows, a repeated id, null ids and sources, and clashing columns."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "a", "é", "z", ""]), rnd.choice(["en", None]), i, rnd.choice([None, "", "x\ny", "\n", "漢字 don't  12　x"]), "c", "c", "c", "c") for i in range(150)]
    rows += [(None, None, None, None, None, "c", "c", "c", "c"), (7, None, "en", 1, "one\nleaf", "c", "c", "c", "c"), (900, "only", "en", 1, "q" * 70_000 + "\n", "c", "c", "c", "c")]
    rows += [rows[3], rows[3], (rows[5][0], rows[5][1], "de", 5, "same id", "c", "c", "c", "c"), (None, "a", None, 2, "null id", "c", "c", "c", "c")]
    return spark.createDataFrame(rows, DOC)


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for now in levels[:-1]:
        a = i - i % 3
        out.append(("".join(now[a:i]), "".join(now[i + 1 : a + 3])))
        i //= 3
    return out


def manifest_of(rows, later):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows; later: the text of a row at the check."""
    trees = defaultdict(list)
    for r in rows:
        then = leaf_of(r)
        trees[r[1]].append((r[0], then, leaf_of((*r[:4], later(r)))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {s: climb([x[1] for x in trees[s]]) for s in names}
    high = climb([low[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, then, now) in enumerate(trees[s]):
            path = siblings(low[s], i) + siblings(high, k)
            folded = now
            for a, b in path:
                folded = h(a, folded, b)
            out.append((doc_id, then, low[s][-1][0], high[-1][0], h(*(a + b for a, b in path)), folded, folded == high[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def later_text():
    return {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, docs, levels):
    got = merkle.manifest(docs, later_text(), levels=levels)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    later = lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4]
    found = got.collect()
    assert sorted(map(str, ([*(r[c] for c in COLUMNS)] for r in found))) == sorted(map(str, map(list, manifest_of(rows, later))))
    assert all(merkle.fold(r["leaf"], r["lefts"], r["rights"]) == r["root"] and merkle.proof(r["lefts"], r["rights"]) == r["proof_sha256"] for r in found)
    assert {r["verified"] for r in found} == {True, False}


def test_manifest_without_changes_or_rows(spark, docs):
    assert merkle.manifest(docs, proofs=False).where("not verified").count() == 0
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 900")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["lefts"] == [] and one[0]["proof_sha256"] == h()


def test_manifest_of_many_small_trees(spark):
    rows = [(i, f"s{i % 400:03}", "en", 1, "t") for i in range(1000)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id int, source string, lang string, n_chars int, text string"), levels=2)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(manifest_of(rows, lambda r: r[4]))


# prefix encoder


@pytest.fixture(scope="module")
def library():
    ranks = prefix_bpe.ranks_of(RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=prefix_bpe._SPLIT.pattern, mergeable_ranks=ranks.index, special_tokens={})


def texts(rnd):
    kind = rnd.choice(["aab ", "abcdefgh", "é漢字ñöß ", "  \n\t'srelv x", "0123456789.,!? ", "the and of ing tion er ", "<|endoftext|>"])
    if rnd.random() < 0.2:
        return "".join(chr(rnd.randrange(1, 0x2FFF)) for _ in range(rnd.choice([1, 3, 40])))
    return "".join(rnd.choice(kind) for _ in range(rnd.choice([0, 1, 3, 10, 40, 200])))


def test_prefixes_encode_as_the_library(library):
    ranks, encoding = library
    rnd = random.Random(1)
    for _ in range(1500):
        piece = bytes(rnd.choice(b"ab e") if rnd.random() < 0.7 else rnd.randrange(256) for _ in range(rnd.randrange(1, 30)))
        assert ranks.encode(piece) == encoding._encode_single_piece(piece)


def test_one_last_token_fits_each_prefix(library):
    ranks, _ = library
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(["in", "ter", "nation", "al", "iz", "ation", "s", "é"]) for _ in range(5)).encode()
        last: list[int] = []
        ranks.extend(text, last)
        for end in range(1, len(text) + 1):
            fits = [t for n in range(1, end + 1) if (t := ranks.index.get(text[end - n : end])) is not None and (n == end or ranks.follows(last[end - n - 1], t))]
            assert fits == [last[end - 1]] and ranks.ids(last[:end]) == ranks.encode(text[:end])


def test_ranks_that_fall_are_merged_by_hand(tmp_path):
    import base64

    words = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"cd"]  # abc has a lower rank than its parts
    path = tmp_path / "falling.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" " + str(i).encode() for i, w in enumerate(words)))
    ranks = prefix_bpe.Ranks(str(path))
    encoding = tiktoken.Encoding("falling", pat_str=".+", mergeable_ranks=ranks.index, special_tokens={})
    rnd = random.Random(4)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 12)))
        assert ranks.encode(piece) == encoding._encode_single_piece(piece), piece


def test_appends_and_edits(library):
    ranks, encoding = library
    rnd = random.Random(7)
    for _ in range(250):
        x = prefix_bpe.Prefixes(ranks, texts(rnd))
        for _ in range(5):
            s, more = x.text, texts(rnd)[: rnd.choice([1, 2, 5, 300])]
            if rnd.random() < 0.4:
                x.append(more)
                s += more
            else:
                a = rnd.randrange(len(s) + 1)
                b = min(len(s), a + rnd.choice([0, 1, 3, 30]))
                x.replace(a, b, more)
                s = s[:a] + more + s[b:]
            assert x.text == s and x.ids() == encoding.encode_ordinary(s)


def test_edits_cost_what_they_change(library):
    ranks, encoding = library
    rnd = random.Random(8)
    x = prefix_bpe.Prefixes(ranks, "".join(rnd.choice(["inter", "nation", "alize", "xq", "zu"]) for _ in range(20_000)))
    before = x.work
    x.replace(40_000, 40_003, "W")
    x.append("end")
    assert x.ids() == encoding.encode_ordinary(x.text) and x.work - before < 2_000


def test_texts_encode_and_decode(spark, docs, library):
    _, encoding = library
    more = spark.createDataFrame([(1000 + i, texts(random.Random(i))) for i in range(200)], "doc_id long, text string")
    table = docs.select("doc_id", "text", "ids", "decoded").unionByName(more.withColumn("ids", F.lit("c")).withColumn("decoded", F.lit("c")))
    got = prefix_bpe.decode_ids(prefix_bpe.encode_texts(table, RANKS), RANKS)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"] and got.count() == table.count()
    for r in got.collect():
        want = encoding.encode_ordinary(r["text"] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert prefix_bpe.decode_ids(prefix_bpe.encode_texts(table.limit(0), RANKS), RANKS).collect() == []


def test_unknown_ids_raise(library):
    with pytest.raises(ValueError):
        library[0].decode(np.array([50256], np.uint32))


def test_query_of_whole_texts(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in table.collect():
        ids = library[1].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), h(r["text"] or "")))
    got = queries.op12_prefix_bpe(spark, SF)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)


# hard negatives


def mined(rows, anchor, positives=5, negatives=5, percent=80):
    whole = [(i, r[0], r[1], [int(np.floor(256 * float(x))) for x in r[2]]) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    out = []
    for i, a, label, v in whole:
        if not anchor(a):
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=False)), b, j, other) for j, b, other, w in whole if j != i), key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))
        for p, one, _, _ in [s for s in scored if s[3] == label][:positives]:
            found = [s for s in scored if s[3] != label and percent * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(a, one, k + 1, s[1], p, s[0]) for k, s in enumerate(found)]
    return sorted(map(str, out))


VECTORS = "vec_id long, label int, embedding array<double>, anchor string, score string"


def same_as_mined(spark, rows, **how):
    table = spark.createDataFrame([(*r, "c", "c") for r in rows], VECTORS)
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, **how)
    found = sorted(str((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])) for r in got.collect())
    assert found == mined(rows, lambda a: a is not None and a % 10 == 0)
    return found


@pytest.mark.parametrize(("tile", "run", "levels"), [(8192, 4096, 3), (8, 32, 1), (4, 1000, 5)])
def test_hard_negatives(spark, tile, run, levels):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(4, 20))
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])), (middle[rng.integers(4)] + rng.normal(scale=0.7, size=20)).tolist()) for i in range(260)]
    rows += [(300 + i, i % 2, rows[0][2]) for i in range(40)]  # copies: ties in ids' order
    rows += [(400, None, rows[0][2]), (410, 0, None), (420, 0, [1.0, None]), (430, 0, [float("nan")] * 20), (440, 1, [float("inf")] + [0.0] * 19), (450, 0, []), (460, 0, [0.0] * 20), (470, 1, rows[1][2][:5])]
    rows += [(None, 0, rows[0][2]), (500, 7, rows[2][2]), rows[10], (20, 1, rows[5][2])]
    assert len(same_as_mined(spark, rows, tile=tile, run=run, levels=levels)) > 100


@pytest.mark.parametrize("scale", [1e-6, 3.0, 1e5, 1e6])
def test_sizes_of_components(spark, scale):
    rng = np.random.default_rng(3)
    same_as_mined(spark, [(i, int(i % 3), (rng.normal(size=7) * scale).tolist()) for i in range(60)])


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError):
        same_as_mined(spark, [(i, 0, [1e12 * i]) for i in range(5)])


def test_no_vectors_no_negatives(spark):
    assert same_as_mined(spark, [(0, None, [1.0]), (1, 0, None)]) == []
    assert same_as_mined(spark, [(0, 1, [1.0]), (10, 2, [1.0])]) == []
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []


def test_intervals_hold_and_leave_out():
    """No pair is outside its interval, and with clustered rows few are scored."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 64))
    v = np.floor(256 * (middle[rng.integers(40, size=4000)] + rng.normal(scale=0.3, size=(4000, 64)))).astype(float)
    turn = hard_negatives.rotation(64)
    bits, along, left, length = hard_negatives.codes(v @ turn)
    a = hard_negatives.Anchors(v[:50] @ turn)
    guess = sum(along[k] * a.along(slice(0, 50), bits[k], True) for k in range(3))
    assert (np.abs(guess - v[:50] @ v.T) <= a.length[:, None] * left[-1] + a.off[:, None] * length[-1] + 1e-3).all()
    ids = np.arange(4000)
    label = rng.integers(2, size=4000)
    none = np.iinfo(np.int64)
    cell = hard_negatives.Cell(v[:50], v[:50] @ turn, ids[:50], label[:50], np.full((50, 1), none.min), np.full((50, 1), none.max), True, 5)
    cell.meet(v, ids, ids, label, (bits, along, left, length))
    assert cell.scored < 0.1 * cell.pairs


def test_queries_on_tables_with_more_columns(spark, tmp_path):
    for name, table in (("op11_merkle", "documents"), ("op12_prefix_bpe", "documents"), ("op13_hard_negatives", "embeddings")):
        plain = spark.read.parquet(f"{SF}/{table}.parquet")
        more = tmp_path / name
        plain.select("*", *[F.lit("c").alias(c) for c in ("leaf", "ids", "anchor", "row", "_tree", "digest")]).write.parquet(f"{more}/{table}.parquet")
        query = queries.queries()[name]
        assert sorted(map(str, query(spark, str(more)).collect())) == sorted(map(str, query(spark, SF).collect()))
