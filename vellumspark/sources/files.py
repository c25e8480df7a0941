"""Files as rows: folder scans, text, DOCX and type maps; writers of reports (SRC-5, SRC-8..SRC-12, SNK-1..SNK-3)."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: file types and their media types
TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "txt": "text/plain", "md": "text/markdown", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp",
}


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """SRC-5, SRC-8: (path, relative_path, file_type, media_type, size, mtime[, content]) of allowed files, hidden ones left out. Contents are read only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*TYPES, *map(str.upper, TYPES)]) + "}").load(folder)
    kind = F.lower(F.substring_index("path", ".", -1))
    media = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    df = df.withColumn("relative_path", F.regexp_replace("path", rf"^.*?\Q{root}\E/+", "")).where(~F.col("relative_path").rlike(r"(^|/)\.")).withColumn("file_type", kind)
    cols = ["path", "relative_path", "file_type", F.element_at(media, F.col("file_type")).alias("media_type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return df.select(*cols, *(["content"] if content else []))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """SRC-12: a DOCX body's paragraphs, insertions kept and deletions left out; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(f"{_W}p"):
        parts = []

        def walk(e):
            if e.tag in (f"{_W}del", f"{_W}moveFrom"):
                return
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
            for c in e:
                if c.tag != f"{_W}p":
                    walk(c)

        walk(p)
        out.append("".join(parts))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def docx(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else docx_text(bytes(b)))


def index_source(documents: DataFrame, path: str = "path", pdf: str = "pdf_path") -> DataFrame:
    """SRC-9: the file that is indexed: of DOC and DOCX the PDF rendition where there is one, else the file itself."""
    office = F.lower(F.substring_index(path, ".", -1)).isin("doc", "docx")
    return documents.withColumn("source_path", F.when(office & F.col(pdf).isNotNull(), F.col(pdf)).otherwise(F.col(path)))


def read_texts(files: DataFrame) -> DataFrame:
    """SRC-10, SRC-12: files of scan(content=True) with text: TXT and MD decoded, DOCX by paragraphs; others are null (their text is an input elsewhere)."""
    text = F.when(F.col("file_type").isin("txt", "md"), F.decode("content", "UTF-8")).when(F.col("file_type") == "docx", docx("content"))
    return files.withColumn("text", text).drop("content")


def write_report(df: DataFrame, path: str) -> None:
    """SNK-2, SRC-16: JSON lines; never over an existing report."""
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """SNK-1: CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def event_lines(df: DataFrame, order: str) -> DataFrame:
    """SNK-3: ``data: {json}`` lines of rows."""
    return df.select(order, F.concat(F.lit("data: "), F.to_json(F.struct(*df.columns)), F.lit("\n\n")).alias("value"))
