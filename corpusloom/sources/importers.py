"""Documents from files, as Markdown: text, HTML, CSV, code, JSON lines, and zipped office formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_ROWS = 500
# fixed values: extensions that are imported as fenced code
CODE = (
    "py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "cs", "go", "rs", "rb", "php", "swift", "kt", "sh", "bash", "zsh", "fish", "lua", "r", "m", "jl",
    "yaml", "yml", "toml", "ini", "cfg", "conf", "json", "xml", "sql", "dockerfile", "makefile",
)


def strip_html(html) -> object:
    """Tags away, runs of three or more line ends down to two."""
    return F.btrim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def html_outline(html) -> object:
    """HTML as Markdown-like text: headings and paragraphs on lines of their own, scripts, styles and tags away."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    for n in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|article|section|nav|ul|ol|table|footer|header|h[1-6])\b[^>]*>", "\n\n")
    return strip_html(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ext, content) of every file under `path`, a whole file a row; bad UTF-8 becomes replacement signs."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return rows.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "content")


def as_markdown(files: DataFrame) -> DataFrame:
    """(path, name, markdown) of text files by extension: Markdown as it is, HTML stripped, code fenced, other text under a
    heading with its name."""
    code = F.concat(F.lit("```"), F.col("ext"), F.lit("\n"), F.col("content"), F.lit("\n```"))
    body = F.when(F.col("ext").isin("md", "markdown"), F.col("content")).when(F.col("ext").isin("html", "htm"), strip_html(F.col("content"))).when(F.col("ext").isin(*CODE), code)
    return files.select("path", "name", body.otherwise(F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("content"))).alias("markdown"))


def csv_markdown(spark: SparkSession, path: str, rows: int = CSV_ROWS) -> DataFrame:
    """(line, text): a CSV file as the lines of a Markdown table, its first `rows` data rows, with a note if there are more.
    Short rows are padded, bars escaped."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\|", r"\\|") for c in raw.columns]
    body = raw.select(F.monotonically_increasing_id().alias("at"), bar(cells).alias("text")).orderBy("at").limit(rows + 1)
    body = body.withColumn("line", F.row_number().over(Window.orderBy("at")) + 1).select("line", "text")
    head = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("line"), bar([F.lit(c.replace("|", "\\|")) for c in raw.columns]).alias("text")), F.struct(F.lit(1).alias("line"), bar([F.lit("---")] * len(raw.columns)).alias("text")))).alias("r")).select("r.*")
    over = body.groupBy().agg(F.max("line").alias("line")).where(F.col("line") > rows + 1).select(F.lit(rows + 2).alias("line"), F.lit(f"*(first {rows} rows)*").alias("text"))
    return head.union(body.where(F.col("line") <= rows + 1)).union(over)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def page_ranges(text, pages) -> object:
    """Sorted distinct page numbers of `1-5,7`, of a document of `pages` pages: an open end (`9-`, `-3`) goes to the last or
    from the first page, and pages that the document lacks are left out. Null for an empty text or `all`, which stands for
    every page, and where nothing is left; parts that are no range are ignored."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x.rlike(r"^(\d+|\d*-\d*)$") & (x != ""))
    first = lambda x: F.coalesce(F.regexp_extract(x, r"^(\d*)", 1).try_cast("int"), F.lit(1))
    last = lambda x: F.when(x.contains("-"), F.coalesce(F.regexp_extract(x, r"(\d*)$", 1).try_cast("int"), pages)).otherwise(first(x))
    low, high = lambda x: F.greatest(F.lit(1), first(x)), lambda x: F.least(pages, last(x))
    ends = F.transform(parts, lambda x: F.when(low(x) <= high(x), F.sequence(low(x), high(x))).otherwise(F.array().cast("array<int>")))
    found = F.array_sort(F.array_distinct(F.flatten(ends)))
    return F.when((F.size(found) > 0) & ~F.lower(F.trim(text)).isin("all", ""), found)


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(data: bytes) -> str:
    """Paragraphs of a DOCX file; heading and list styles become Markdown marks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{WORD_NS}p"):
        text = "".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip()
        style = p.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
        name = style.get(f"{WORD_NS}val", "") if style is not None else ""
        level = re.fullmatch(r"[Hh]eading ?([1-6])", name)
        if text:
            out.append("#" * int(level[1]) + " " + text if level else f"- {text}" if name.startswith("List") else text)
    return "\n\n".join(out)


def odt_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    lines = ("".join(x.itertext()).strip() for x in root.iter() if x.tag.rsplit("}", 1)[-1] in ("p", "h"))
    return "\n\n".join(x for x in lines if x)


def office(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown, error) of the DOCX and ODT files under `path`; a file that can't be read has an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((p, docx_markdown(data) if p.lower().endswith(".docx") else odt_text(data), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,odt}").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")
