"""Documents from files, by extension, with an error column instead of failing tasks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = {"png", "jpg", "jpeg", "tiff", "tif"}
LEAST_PDF_TEXT, MOST_BYTES = 200, 50 * 1024 * 1024


def backend(path):
    """The reader that a path's extension (any case) calls for, as a column; null for unknown ones."""
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    named = F.when(kind.isin("txt", "pdf", "docx", "xlsx", "pptx"), kind)
    return named.when(kind.isin(*sorted(IMAGES)), "image")


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == leaf)


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in _xml(z, "word/document.xml") if _local(x.tag) == "body")
    lines = [_texts(x) for x in body if _local(x.tag) == "p"]
    for table in (x for x in body if _local(x.tag) == "tbl"):
        for row in (x for x in table.iter() if _local(x.tag) == "tr"):
            lines.append(" | ".join(_texts(c).strip() for c in row if _local(c.tag) == "tc"))
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(data: bytes) -> str:
    """[Sheet: name], then rows of cells joined by bars, without blank cells and rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_texts(x) for x in _xml(z, "xl/sharedStrings.xml") if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [x.get("name") for x in _xml(z, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        lines = []
        for title, name in zip(titles, sheets, strict=False):
            lines.append(f"[Sheet: {title}]")
            for row in (x for x in _xml(z, name).iter() if _local(x.tag) == "row"):
                cells = []
                for c in row:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), None)
                    text = _texts(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value else value or ""
                    cells.append(text.strip())
                if any(cells):
                    lines.append(" | ".join(x for x in cells if x))
    return "\n".join(lines)


def pptx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for k, name in enumerate(slides, 1):
            lines = [_texts(p) for p in _xml(z, name).iter() if _local(p.tag) == "p"]
            out.append("\n".join([f"[Slide {k}]", *(x for x in lines if x.strip())]))
    return "\n".join(out)


def parse_one(path: str, data: bytes, pdf=None, ocr=None) -> tuple[str | None, str | None]:
    """(text, error). ``pdf`` and ``ocr`` (bytes to text) are the caller's; a PDF with under 200 characters is
    read by ``ocr``."""
    kind = path.rpartition(".")[2].lower()
    try:
        if not data:
            return None, "empty file"
        if kind == "txt":
            return data.decode("utf-8", "replace"), None
        if kind in ("docx", "xlsx", "pptx"):
            return {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}[kind](data), None
        if kind == "pdf" and pdf:
            text = pdf(data)
            return (ocr(data) if ocr and len(text.strip()) < LEAST_PDF_TEXT else text), None
        if kind in IMAGES and ocr:
            return ocr(data), None
        return None, f"unsupported type: {kind}" if kind not in {"pdf", *IMAGES} else f"no reader for {kind}"
    except Exception as e:  # a broken file is a row, not a failed job
        return None, f"{type(e).__name__}: {e}"[:500]


def parsed(files: DataFrame, pdf=None, ocr=None) -> DataFrame:
    """binaryFile rows: path, document_id, size, text, error."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_one(p, bytes(c), pdf, ocr) for p, c in zip(path, content, strict=True)], columns=["text", "error"])

    rows = files.withColumn("_r", run("path", "content"))
    return rows.select("path", F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 32)).alias("document_id"), F.length("content").alias("size"), F.col("_r.text"), F.col("_r.error"))


def read_files(spark: SparkSession, path: str, pdf=None, ocr=None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All files under ``path``, parsed. Files that are too large or of no known type are named in ``error`` and not
    read; empty ones are no rows of Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    problem = F.when(F.col("length") > most_bytes, "too large").when(backend(F.col("path")).isNull(), F.concat(F.lit("unsupported type: "), F.lower(F.element_at(F.split("path", r"\."), -1))))
    refused = files.select("path", F.lit(None).cast("string").alias("document_id"), F.col("length").cast("int").alias("size"), F.lit(None).cast("string").alias("text"), problem.alias("error")).filter("error is not null")
    return parsed(files.filter(problem.isNull()), pdf, ocr).unionByName(refused)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions and expected answers; entries without either are dropped."""
    rows = spark.read.schema("question string, ground_truth string").option("multiLine", True).json(path)
    return rows.filter((F.trim("question") != "") & (F.trim("ground_truth") != ""))


def read_memory(spark: SparkSession, path: str, user: str, organization: str, most: int = 10_000) -> DataFrame:
    """An exported memory: only the user's and organisation's own, at most ``most`` messages."""
    kind = "user_id string, organization_id string, messages array<struct<role:string,content:string,timestamp:string>>"
    own = spark.read.schema(kind).option("multiLine", True).json(path).filter((F.col("user_id") == user) & (F.col("organization_id") == organization))
    return own.select("user_id", "organization_id", F.explode(F.slice("messages", 1, most)).alias("m")).select("user_id", "organization_id", "m.*").filter(F.col("role").isin("user", "assistant", "system") & (F.trim("content") != ""))


def load_store(spark: SparkSession, path: str, organization: str, namespace: str, dim: int) -> DataFrame:
    """The scope of a saved store's current version, after checks of that scope alone: its files are as they were
    written (rows, ids, contents, vectors), none is missing or added, and its vectors have the right length."""
    from .sinks import current_version, read_scope

    return read_scope(spark, current_version(spark, path), organization, namespace, dim)


def accepted_files(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """binaryFile rows with ``problem``: empty, too large, or of an unknown type; null if there is none."""
    size = F.coalesce("length", F.length("content"))
    return files.withColumn("problem", F.when(size == 0, "empty").when(size > most_bytes, "too large").when(backend(F.col("path")).isNull(), "unsupported type"))
