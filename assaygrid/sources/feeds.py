"""Literature feeds as DataFrames (SC11-SC15): responses in a string column become rows of papers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.functions.text import strip_tags

PAPER = ["source", "id", "title", "abstract", "year", "url", "authors"]

_CROSSREF = "struct<message:struct<items:array<struct<DOI:string,title:array<string>,abstract:string,URL:string,author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>>>>>"
_EUROPE = "struct<resultList:struct<result:array<struct<id:string,doi:string,pmcid:string,pmid:string,title:string,abstractText:string,authorString:string,pubYear:string,firstPublicationDate:string>>>>"
_OPENALEX = "struct<results:array<struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>>>"
_SCHOLAR = "struct<data:array<struct<paperId:string,title:string,abstract:string,year:int,url:string,authors:array<struct<name:string>>,externalIds:struct<ArXiv:string,DOI:string>>>>"


def _rows(df: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    return df.select(F.from_json(F.col(column), schema).alias("j")).select(F.explode(f"j.{path}").alias("r"))


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def crossref(df: DataFrame, column: str = "body") -> DataFrame:
    """SC12: five authors at most, tags taken out of abstracts, the year of print, online or publication."""
    r = _rows(df, column, _CROSSREF, "message.items")
    year = F.coalesce(*[F.get(F.get(F.col(f"r.`{k}`.`date-parts`"), 0), 0) for k in ("published-print", "published-online", "published")])
    authors = F.slice(F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), 1, 5)
    return r.select(F.lit("crossref").alias("source"), F.col("r.DOI").alias("id"), F.get("r.title", 0).alias("title"), strip_tags(F.col("r.abstract")).alias("abstract"), year.cast("string").alias("year"), F.col("r.URL").alias("url"), authors.alias("authors"))


def europe_pmc(df: DataFrame, column: str = "body") -> DataFrame:
    """SC13: ids and addresses by DOI, PMC id, PubMed id, id."""
    r = _rows(df, column, _EUROPE, "resultList.result")
    doi, pmc, pm = (_some(F.col(f"r.{k}")) for k in ("doi", "pmcid", "pmid"))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://europepmc.org/article/PMC/"), pmc), F.concat(F.lit("https://europepmc.org/article/MED/"), pm))
    year = F.coalesce("r.pubYear", F.substring("r.firstPublicationDate", 1, 4))
    authors = F.slice(F.filter(F.transform(F.split("r.authorString", ","), lambda a: F.trim(a)), lambda a: a != ""), 1, 5)
    return r.select(F.lit("europe_pmc").alias("source"), F.coalesce(doi, pmc, pm, F.col("r.id")).alias("id"), F.col("r.title").alias("title"), F.col("r.abstractText").alias("abstract"), year.alias("year"), url.alias("url"), authors.alias("authors"))


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def to_inverted(words: pa.Array) -> pa.Array:
    """{word: [places]} of each array of words, so that no word leaves its row's task."""
    out = []
    for row in words:
        places: dict[str, list[int]] = {}
        for at, word in enumerate(row.as_py() or ()):
            places.setdefault(word, []).append(at)
        out.append(list(places.items()) if row.is_valid else None)
    return pa.array(out, pa.map_(pa.string(), pa.list_(pa.int32())))


def from_inverted(index: Column) -> Column:
    """A text from {word: [places]}."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def openalex(df: DataFrame, column: str = "body") -> DataFrame:
    """SC14."""
    r = _rows(df, column, _OPENALEX, "results")
    doi = F.regexp_replace("r.doi", "^https?://doi\\.org/", "")
    authors = F.slice(F.transform("r.authorships", lambda a: a["author"]["display_name"]), 1, 5)
    return r.select(F.lit("openalex").alias("source"), F.coalesce(doi, F.col("r.id")).alias("id"), F.col("r.title").alias("title"), from_inverted(F.col("r.abstract_inverted_index")).alias("abstract"), F.col("r.publication_year").cast("string").alias("year"), F.coalesce(F.col("r.doi"), F.col("r.id")).alias("url"), authors.alias("authors"))


def semantic_scholar(df: DataFrame, column: str = "body") -> DataFrame:
    """SC15: rows without an abstract go; an arXiv address if there is such an id."""
    r = _rows(df, column, _SCHOLAR, "data").where(_some(F.col("r.abstract")).isNotNull())
    url = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), F.col("r.externalIds.ArXiv")), F.col("r.url"))
    return r.select(F.lit("semantic_scholar").alias("source"), F.col("r.paperId").alias("id"), F.col("r.title").alias("title"), F.col("r.abstract").alias("abstract"), F.col("r.year").cast("string").alias("year"), url.alias("url"), F.slice(F.transform("r.authors", lambda a: a["name"]), 1, 5).alias("authors"))


def arxiv(df: DataFrame, column: str = "body") -> DataFrame:
    """SC11: entries of an Atom feed that have a title and an abstract."""
    entries = F.from_xml(F.regexp_replace(column, r'\sxmlns(:\w+)?="[^"]*"', ""), "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>")
    r = df.select(F.explode(entries["entry"]).alias("r"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = r.select(F.lit("arxiv").alias("source"), F.regexp_extract("r.id", r"abs/(.+)$", 1).alias("id"), squeeze("r.title").alias("title"), squeeze("r.summary").alias("abstract"), F.substring("r.published", 1, 4).alias("year"), F.col("r.id").alias("url"), F.slice(F.transform("r.author", lambda a: a["name"]), 1, 5).alias("authors"))
    return out.where("coalesce(title, '') <> '' and coalesce(abstract, '') <> ''")
