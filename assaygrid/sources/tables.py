"""Files of experiments as tables (SC1-SC4, SC7, RD1-RD7, RD16-RD18, PJ8): CSV, TSV, XLSX with declared roles, cached parquet."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.operators.clean import drop_empty, trim_strings
from assaygrid.operators.order import numbered_as_read

# Words of role cells, and names of required columns.
METADATA_WORDS = ("metadata", "meta", "identifier", "info")
OUTPUT_WORDS = ("dependent", "dep", "output", "response", "target", "outcome", "result", "measure")
INPUT_WORDS = ("independent", "indep", "input", "predictor", "covariate", "explanatory", "feature", "variable")
ID_NAMES = ("experiment_id", "exp_id", "run_id", "sample_id", "condition", "cond")
TIME_NAMES = ("time_min", "time_mins", "time_(min)", "time(min)", "time", "t_min", "timepoint", "time_point")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


@dataclass(frozen=True)
class Roles:
    metadata: list[str] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    entity: str | None = None
    time: str | None = None

    def layout(self) -> dict:
        """RD18."""
        return {"metadata": self.metadata, "inputs": self.inputs, "outputs": self.outputs, "entity": self.entity, "time": self.time}


def names_basic(names: list[str], dashes: bool = False) -> list[str]:
    """Dialects N1 and, with dashes, N2."""
    return [re.sub(r"[ -]" if dashes else " ", "_", str(n).strip().lower()) for n in names]


def names_unified(names: list[str]) -> list[str]:
    """RD6, dialect N3: plain, no empty and no repeated names; the n-th one more of a name ends in __n."""
    text = ("" if n is None else str(n) for n in names)
    plain = [re.sub(r"[\s\-()/,_]+", "_", t.strip().lower().replace("°", "").replace("μ", "u").replace("µ", "u")).strip("_") or "col" for t in text]
    before = [plain[:i].count(n) for i, n in enumerate(plain)]
    return [f"{n}__{k}" if k else n for n, k in zip(plain, before, strict=True)]


#: RD1: what a role cell says, the first rule that holds; begins, contains, and lacks are words of the trimmed lower-case cell.
ROLE_RULES = (
    ("metadata", "begins", METADATA_WORDS, None),
    ("output", "contains", OUTPUT_WORDS, "independent"),
    ("input", "contains", INPUT_WORDS, None),
)


def role_of(cell: object) -> str:
    """RD1: metadata, output, input or unknown."""
    text = " ".join(str("" if cell is None else cell).lower().split())
    for role, how, words, lacks in ROLE_RULES:
        found = [w for w in words if (text.startswith(w) if how == "begins" else w in text)]
        if found and not (lacks and lacks in text):
            return role
    return "unknown"


def role_column(cell: Column) -> Column:
    """role_of of every row."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), r"\s+", " "))
    out = F.lit("unknown")
    for role, how, words, lacks in reversed(ROLE_RULES):
        hit = F.lit(False)
        for w in words:
            hit = hit | (text.startswith(w) if how == "begins" else text.contains(w))
        out = F.when(hit & ~text.contains(lacks) if lacks else hit, role).otherwise(out)
    return out


def find_header_pair(grid: list[list[object]], rows: int = 16) -> int | None:
    """RD2: the row of roles whose next row holds the names."""
    text = lambda c: c is not None and str(c).strip() != ""
    for i in range(min(rows, len(grid) - 1)):
        roles = [role_of(c) for c in grid[i]]
        names = grid[i + 1]
        named = sum(map(text, names))
        role_like = sum(role_of(c) != "unknown" for c in names)
        known = sum(r != "unknown" for r in roles)
        if "input" in roles and "output" in roles and known >= 2 and named >= max(2, len(grid[i]) // 5) and 2 * role_like <= named:
            return i
    return None


def fill_roles(cells: list[object]) -> list[str]:
    """RD3: a cell without a role has the last one's; the first ones are inputs."""
    out, last = [], "input"
    for c in cells:
        r = role_of(c)
        last = r if r != "unknown" else last
        out.append(last)
    return out


def required(names: list[str], candidates: tuple[str, ...]) -> str | None:
    """RD4: exact, then by how a name begins."""
    return next((c for c in candidates if c in names), None) or next((n for c in candidates for n in names if n.startswith(c)), None)


def roles_from(names: list[str], cells: list[object]) -> Roles:
    """RD5: declared roles; id, time and condition columns are no inputs."""
    roles = fill_roles(cells)
    of = lambda kind: [n for n, r in zip(names, roles, strict=True) if r == kind]
    entity, time = required(names, ID_NAMES), required(names, TIME_NAMES)
    inputs = [n for n in of("input") if n not in (entity, time) and not n.startswith("condition")]
    return Roles(of("metadata"), inputs, of("output"), entity, time)


def header_score(row: list[object], following: list[object] | None) -> float:
    """RD7: how much a row looks like a header."""
    cells = [str(c).strip() for c in row if c is not None and str(c).strip()]
    number = lambda x: re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x) is not None
    score = 2.0 * min(len(cells), 12)
    for c in cells:
        score += -8 if len(c) > 100 else 0.35 if len(c) <= 64 else 0
        score -= 1.2 if number(c) else 0
    score -= 6 if len(cells) <= 2 else 0
    if following is not None:
        after = [str(c).strip() for c in following if c is not None and str(c).strip()]
        numeric = sum(map(number, after))
        score += 4 if after and 2 * numeric >= len(after) else 2 if numeric else 0
    return score


def infer_header(grid: list[list[object]], rows: int = 10) -> int:
    """SC4: the row of the highest score; blank rows between a row and the one that follows it do not count."""
    filled = lambda r: any(c is not None and str(c).strip() for c in r)
    scores = [header_score(r, next((grid[j] for j in range(i + 1, len(grid)) if filled(grid[j])), None)) for i, r in enumerate(grid[:rows])]
    return max(range(len(scores)), key=lambda i: (scores[i], -i)) if scores else 0


def xlsx_grid(data: bytes) -> list[list[object]]:
    """Cells of a workbook's first sheet, as numbers, strings or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in root.iter(f"{_SHEET}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        grid: list[list[object]] = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_SHEET}row"):
            at = int(row.get("r", len(grid) + 1)) - 1
            while len(grid) <= at:
                grid.append([])
            for c in row.iter(f"{_SHEET}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                col = 0
                for ch in letters[0] if letters else "":
                    col = col * 26 + ord(ch) - 64
                col = col - 1 if letters else len(grid[at])
                while len(grid[at]) <= col:
                    grid[at].append(None)
                value, kind = c.find(f"{_SHEET}v"), c.get("t")
                if kind == "inlineStr":
                    grid[at][col] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    grid[at][col] = shared[int(value.text)] if kind == "s" else value.text if kind in ("str", "e") else value.text == "1" if kind == "b" else float(value.text)
    width = max(map(len, grid), default=0)
    return [r + [None] * (width - len(r)) for r in grid]


def _from_grid(spark: SparkSession, names: list[str], rows: list[list[object]]) -> DataFrame:
    schema = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    text = lambda c: None if c is None else format(c, ".15g") if isinstance(c, float) else str(c)
    return spark.createDataFrame([(i, *map(text, r)) for i, r in enumerate(rows)], schema)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file through Spark's own readers, from any store."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_unified(spark: SparkSession, path: str) -> tuple[DataFrame, Roles]:
    """SC3: a workbook with a row of roles above a row of names, both within its first rows; ValueError without."""
    grid = xlsx_grid(read_bytes(spark, path))
    at = find_header_pair(grid[:40])
    if at is None:
        raise ValueError("no pair of role and name rows in the workbook")
    names = names_unified(grid[at + 1])
    df = trim_strings(drop_empty(_from_grid(spark, names, grid[at + 2 :])))
    have = set(df.columns)
    r = roles_from(names, grid[at])
    keep = lambda xs: [x for x in xs if x in have]  # noqa: E731  a declared column that is empty is gone
    return df, Roles(keep(r.metadata), keep(r.inputs), keep(r.outputs), r.entity if r.entity in have else None, r.time if r.time in have else None)


def read_smart(spark: SparkSession, path: str) -> DataFrame:
    """SC4: a workbook whose header row is found by its looks."""
    grid = xlsx_grid(read_bytes(spark, path))
    at = infer_header(grid)
    return trim_strings(drop_empty(_from_grid(spark, names_unified(grid[at]), grid[at + 1 :])))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", row_id: bool = True, multi_line: bool = False) -> DataFrame:
    """SC1, SC2: a CSV or TSV as trimmed strings (types are for the profile to tell), with its line order as row_id.

    Large files are split. multi_line: quoted cells may hold line ends; a file is then read by one task.
    """
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=multi_line, escape='"')
    df = raw.toDF(*names_unified(raw.columns))
    if row_id:
        df = numbered_as_read(df, "row_id")
    return trim_strings(drop_empty(df))


def legacy_layout(columns: list[str], inputs: tuple[int, int] = (2, 37), outputs: int = 37) -> Roles:
    """PJ8: roles by position; ValueError if there are too few columns."""
    if len(columns) < outputs:
        raise ValueError(f"{len(columns)} columns; the layout needs {outputs}")
    return Roles(columns[: inputs[0]], columns[inputs[0] : inputs[1]], columns[outputs:])


def content_key(spark: SparkSession, path: str) -> str:
    """SK1: the name of a file's cached table; an executor makes the digest, and only that reaches the driver."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0][:16]


def cached(spark: SparkSession, path: str, cache: str, read) -> DataFrame:
    """SC7, SK1: a file's table from the cache, or read, written there and read again."""
    at = f"{cache.rstrip('/')}/{content_key(spark, path)}.parquet"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        read(spark, path).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def tenant_folder(subject: str) -> str:
    """SK2."""
    return "user_" + hashlib.sha256(subject.encode()).hexdigest()[:24]


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name.rsplit("/", 1)[-1]) or "file"
