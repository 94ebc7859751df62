"""Corpus and retrieval (VR, DD, FL14-FL16): chunks, exact top-k by cosine, grounding scores, merging of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaygrid.functions import text as tx
from assaygrid.operators import grid

#: Queries and rows of the corpus that meet in a group.
QUERY_BLOCK, CORPUS_BLOCK = 4096, 8192
#: Queries within so many bytes are broadcast.
SMALL_BYTES = 32 << 20
#: Similarities that agree to so many digits are ties, whatever the order of their sums.
TIE = 12
#: Rows of the corpus that are held against queries at a time.
TILE = 1024
# Thresholds and weights of grounding.
QUERY_MIN, STRONG_MIN, EXTERNAL_MIN = 0.18, 0.30, 0.45
WEIGHTS = {"rag": 0.5, "papers": 0.3, "pass_rate": 0.2}
PROVIDERS = ("openalex", "europe_pmc", "crossref", "semantic_scholar", "arxiv")


def split_chunks(text: str, size: int = 512, overlap: int = 64) -> Iterator[tuple[int, str]]:
    """VR4: (start, chunk) of windows of 4 * size characters that end at a blank line, else a line-ending full stop, else a full stop in their last 30 %."""
    width, back, start, n = 4 * size, 4 * overlap, 0, len(text)
    while start < n:
        hard = min(start + width, n)
        end = hard
        if hard < n:
            floor = start + int(width * 0.70)
            end = next((p + len(b) for b in ("\n\n", ".\n", ". ") if (p := text.rfind(b, floor, hard)) >= 0), hard)
        if piece := text[start:end].strip():
            yield start, piece
        if end >= n:
            return
        start = max(start + 1, end - back)


def chunk(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 512, overlap: int = 64) -> DataFrame:
    """VR4, VR5: doc_id, chunk_index, text, n_tokens, chunk_hash of the text up to its references. Null texts have no chunks."""
    base = docs.select(F.col(doc_id).alias("doc_id"), tx.truncate_references(F.col(text)).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, parts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for j, (_, piece) in enumerate(split_chunks(t or "", size, overlap)):
                    at.append(i)
                    index.append(j)
                    parts.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(parts, pa.string())], ["doc_id", "chunk_index", "text"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])
    out = base.mapInArrow(cut, schema)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.col("text"))
    return out.withColumn("n_tokens", tx.token_estimate(F.col("text"))).withColumn("chunk_hash", F.sha2(key, 256))


def drop_reference_chunks(chunks: DataFrame, text: str = "text") -> DataFrame:
    """FL15."""
    return chunks.where(~tx.is_reference_chunk(F.col(text)) | F.col(text).isNull())


def cosine(a: Column, b: Column) -> Column:
    """VR15: null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class _Nearest:
    """The k best of each of n rows of similarities, ties by the least document, as flat arrays."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.s, self.d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, d: np.ndarray) -> None:
        if not s.size:
            return
        # of the new ones, those not below their k-th best; ties stay in
        least = np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else np.full(self.n, -np.inf)
        row, at = np.nonzero(s >= least[:, None])
        row, s, d = np.append(self.row, row), np.append(self.s, s[row, at]), np.append(self.d, d[at])
        order = np.lexsort((d, -s, row))
        row = row[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        kept = nth < self.k
        self.row, self.s, self.d = row[kept], s[order][kept], d[order][kept]


def _units(ids: np.ndarray, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: ids and unit vectors of those with a length and finite components alone. Ids may repeat."""
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        v = flat[(ends[at] - width)[:, None] + np.arange(width)].astype(float)
        n = np.linalg.norm(v, axis=1)
        ok = (n > 0) & np.isfinite(v).all(1)
        out[width] = ids[at[ok]], v[ok] / n[ok, None]
    return out


class _Search:
    """The k nearest of queries, given the corpus batch by batch."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.queries = queries
        self.best = {width: _Nearest(len(names), k) for width, (names, _) in queries.items() if len(names)}

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        for width, (names, v) in _units(ids, column).items():
            if width in self.best:
                for i in range(0, len(names), TILE):
                    self.best[width].add(np.round(self.queries[width][1] @ v[i : i + TILE].T, TIE), names[i : i + TILE])

    def found(self) -> pa.RecordBatch:
        each = [(self.queries[w][0][b.row], b.d, b.s) for w, b in self.best.items()] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*each, strict=True)], ["q", "d", "s"])


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 8, min_similarity: float | None = None, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "embedding", small: int = SMALL_BYTES) -> DataFrame:
    """VR1, VR2: query_id, doc_id, similarity and rank of each query's k nearest, exact, ties by doc_id.

    Queries whose vectors take less than small bytes are counted first, and then meet the corpus where it lies, as a broadcast. More
    of them are cut into tiles, as is the corpus, and a tile of each meets in a group (operators/grid.py): neither side
    goes through the driver, and the corpus is read once. Tasks keep k a query, and Spark limits a query's rows to k again before
    it shuffles them. Vectors that are null, have no length or hold null or non-finite components match nothing; others
    match those of their number of components. Queries that repeat an id are one query with all their rows. Null ids match nothing.
    """
    kind = lambda df: df.schema[vector].dataType.elementType.typeName()
    typed = "array<float>" if kind(queries) == kind(corpus) == "float" else "array<double>"
    named = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast(typed).alias("v")).where("id is not null")
    # unsound vectors are left out where vectors are read: a filter on v would make them anew for each of its terms
    base = corpus.select(F.col(doc_id).cast("long").alias("id"), F.col(vector).cast(typed).alias("v")).where("id is not null")
    schema = "q long, d long, s double"
    size = named.agg(F.coalesce(F.sum(F.size("v") * F.lit(8) + 16), F.lit(0))).first()[0] if small else 1
    if size <= small:
        rows = named.toArrow().combine_chunks()  # within small bytes
        shared = corpus.sparkSession.sparkContext.broadcast(_units(rows["id"].to_numpy(), rows["v"].combine_chunks()) if rows.num_rows else {})

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _Search(shared.value, k)
            for batch in batches:
                search.add(batch.column(0).to_numpy(), batch.column(1))
            yield search.found()

        parts = base.mapInArrow(nearest, schema)
    else:

        def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for left, right in grid.cells(batches):
                if left.num_rows and right.num_rows:
                    search = _Search(_units(left["id"].to_numpy(), left["v"].combine_chunks()), k)
                    search.add(right["id"].to_numpy(), right["v"].combine_chunks())
                    yield search.found()

        parts = grid.met(named, base, "id", QUERY_BLOCK, CORPUS_BLOCK).mapInArrow(tiled, schema)
    if min_similarity is not None:
        parts = parts.where(F.col("s") >= min_similarity)
    order = [F.desc("s"), F.col("d")]
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), F.round("s", 4).alias("similarity"), "rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DD1, DD3, DD4: of rows with equal keys the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def multi_query(found: DataFrame, k: int) -> DataFrame:
    """VR3: rows of several queries (query_id in their order) as one list: each doc from its first query, the k most similar."""
    once = keep_first(found, ["doc_id"], ["query_id"])
    return once.orderBy(F.desc("similarity"), "doc_id").limit(k)


def literature_score(found: DataFrame, floor: float = QUERY_MIN) -> DataFrame:
    """VR7: query_id and lit_score: its highest similarity of floor or more, else 0."""
    return found.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("similarity") >= floor, F.col("similarity"))), F.lit(0.0)).alias("lit_score"))


def best_external(papers: DataFrame, floor: float = EXTERNAL_MIN, providers: int = 2) -> DataFrame:
    """VR9, VR10: of (candidate, provider, paper, similarity) each provider's best of floor or more, from the first providers in their fixed order."""
    order = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider"))
    best = keep_first(papers.where(F.col("similarity") >= floor).withColumn("_s", -F.col("similarity")), ["candidate", "provider"], ["_s", "paper"]).drop("_s")
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy("candidate").orderBy(order, "provider")))
    return ranked.where(F.col("_n") <= providers).drop("_n")


def grounding_score(df: DataFrame, rag: str, papers: str, pass_rate: str, name: str = "match_score") -> DataFrame:
    """VR11: the weighted mean of corpus, paper and validation scores, within 0 and 1."""
    c = lambda x: F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0))
    total = WEIGHTS["rag"] * c(rag) + WEIGHTS["papers"] * c(papers) + WEIGHTS["pass_rate"] * c(pass_rate)
    return df.withColumn(name, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4))


def rank_grounded(df: DataFrame, top: int = 6) -> DataFrame:
    """TK2: by lit * R2 * diagnostics, then lit, then R2; of the strong ones if there are two or more, else of all."""
    key = F.col("lit_score") * F.col("r_squared") * F.col("diagnostic_score")
    strong = df.agg(F.count_if(F.col("lit_score") >= STRONG_MIN).alias("_strong"))
    ranked = df.withColumn("key", key).join(F.broadcast(strong))  # one row
    chosen = ranked.where((F.col("_strong") < 2) | (F.col("lit_score") >= STRONG_MIN))
    return chosen.orderBy(F.desc("key"), F.desc("lit_score"), F.desc("r_squared"), "id").limit(top).drop("_strong")


def citation_key(url: Column, ident: Column, title: Column) -> Column:
    pick = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.lower(F.coalesce(pick(url), pick(ident), pick(title), F.lit("")))


def dedupe_citations(df: DataFrame, order: list[str]) -> DataFrame:
    """DD3, FL16: rows (url, id, title) once each by their key; those without one go."""
    keyed = df.withColumn("_key", citation_key(F.col("url"), F.col("id").cast("string"), F.col("title"))).where("_key <> ''")
    return keep_first(keyed, ["_key"], order).drop("_key")


def merge_sources(sources: list[tuple[str, DataFrame]], title: str = "title", key: str = "id") -> DataFrame:
    """DD2, JN14: papers of several sources, first source first, as one row a normalized title with all its sources."""
    every = None
    for i, (name, df) in enumerate(sources):
        part = df.select(F.col(key).cast("string").alias("id"), F.col(title).alias("title"), F.lit(name).alias("source"), F.lit(i).alias("priority"))
        every = part if every is None else every.unionByName(part)
    order = F.struct("priority", "id")
    return every.withColumn("norm_title", tx.normal_title(F.col("title"))).where("norm_title <> ''").groupBy("norm_title").agg(F.min_by("id", order).alias("id"), F.min_by("title", order).alias("title"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def pack_context(found: DataFrame, most: int = 4000) -> DataFrame:
    """Context of each query: chunks in rank order while their running length stays within most; a gap ends it."""
    section = F.concat(F.lit("[Source: "), F.substring("title", 1, 80), F.lit(" | File: "), F.col("source_file"), F.lit(" | Similarity: "), tx.fixed(F.col("similarity"), 2), F.lit("]\n"), F.col("text"))
    over = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = found.withColumn("section", section).withColumn("used", F.sum(F.length("section")).over(over)).where(F.col("used") <= most)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))


def stale_chunks(chunks: DataFrame, model: str, tenant: str) -> DataFrame:
    """SC9, VR14: a tenant's chunks with text that lack an embedding, or have another model's."""
    return chunks.where((F.col("user_sub") == tenant) & (F.coalesce(F.col("text"), F.lit("")) != "") & (F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))))


def new_documents(found: DataFrame, known: DataFrame, key: str = "filename") -> DataFrame:
    """JN8, SC6: rows whose key is not known."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """SC16 offline: a text's words hashed into a vector of unit length (or zeros); null texts are zeros. Words are hashed once each."""
    places = F.transform(F.coalesce(tx.words(F.lower(text)), F.array().cast("array<string>")), lambda x: F.pmod(F.xxhash64(x), F.lit(width)))
    # an array of one array, so that its hashes are not made anew for every place
    counts = F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))[0]
    scaled = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(counts), lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x, scaled(c)), F.lit(0.0)).cast("float")))[0]


def register_chunker(spark: SparkSession, name: str = "chunk_text") -> None:
    """The chunker as a table function for SQL: chunk_text(text, size, overlap) gives chunk_index, start and chunk."""

    @F.udtf(returnType="chunk_index int, start int, chunk string")
    class Chunker:
        def eval(self, text: str, size: int, overlap: int):
            for i, (start, piece) in enumerate(split_chunks(text or "", size, overlap)):
                yield i, start, piece

    spark.udtf.register(name, Chunker)


def corpus_citations(found: DataFrame, chunks: DataFrame, floor: float = QUERY_MIN) -> DataFrame:
    """VR8: of each query its nearest chunk, if near enough, as a citation: query_id, source, title, url, similarity_score, snippet (500 characters)."""
    best = found.where((F.col("rank") == 1) & (F.col("similarity") >= floor))
    text = F.coalesce(F.col("text"), F.lit(""))
    cited = best.join(chunks, "doc_id").select("query_id", F.lit("corpus").alias("source"), F.coalesce("title", "source_file").alias("title"), F.col("source_file").alias("url"), F.round("similarity", 4).alias("similarity_score"), F.trim(F.substring(text, 1, 500)).alias("snippet"))
    return cited


def rerank(found: DataFrame, relevance: DataFrame | None, k: int) -> DataFrame:
    """VR6: each query's documents by relevance (query_id, doc_id, relevance) from outside, those without by similarity after them; without any as they are."""
    if relevance is None:
        return found.where(F.col("rank") <= k)
    joined = found.join(relevance, ["query_id", "doc_id"], "left")
    over = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), F.desc("similarity"), "doc_id")
    return joined.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("query_id", "doc_id", "similarity", "rank")


def backfill_embeddings(chunks: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """SK7: chunks with the embeddings (chunk_id, embedding) of those that had none or another model's."""
    new = fresh.select("chunk_id", F.col("embedding").alias("_fresh"))
    out = chunks.join(new, "chunk_id", "left")
    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))
    use = stale & F.col("_fresh").isNotNull()
    return out.withColumns({"embedding_model": F.when(use, F.lit(model)).otherwise(F.col("embedding_model")), "embedding": F.when(use, F.col("_fresh")).otherwise(F.col("embedding"))}).drop("_fresh")
