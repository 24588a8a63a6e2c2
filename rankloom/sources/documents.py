"""Bulk loading of document files into ``filename, text``."""

from __future__ import annotations

import io
import os
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.text import file_name
from rankloom.sources.tables import spread
from rankloom.staging import empty_files, local_path, path_exists, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT_TYPES = (".pdf", ".docx", ".txt")
# Files of a task, and their bytes.
FILES_OF_TASK, BYTES_OF_TASK = 2000, 64 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Body paragraphs of a .docx file, joined with line ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n".join(
        "".join(node.text or "" if node.tag == f"{_W}t" else marks.get(node.tag, "")
                for run in paragraph.iter(f"{_W}r") for node in run)
        for paragraph in body.findall(f"{_W}p"))


# What XML 1.0 cannot hold; it has no escape for these.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                           '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           '<Override PartName="/word/document.xml" ContentType="application/'
                           'vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
                   'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
                   'Target="word/document.xml"/></Relationships>',
}


def docx_bytes(text: str | None) -> bytes:
    """A .docx file with a paragraph per line of the text, which ``docx_text`` reads back.

    Carriage returns become line breaks, and characters that XML cannot hold are left out. Null is the empty text.
    """
    body = []
    for line in _NOT_XML.sub("", text or "").split("\n"):
        pieces = (f'<w:t xml:space="preserve">{escape(p)}</w:t>' if p not in "\t\r" else "<w:tab/>" if p == "\t" else "<w:cr/>"
                  for p in re.split("([\t\r])", line) if p)
        body.append(f"<w:p><w:r>{''.join(pieces)}</w:r></w:p>")
    document = f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in (_PARTS | {"word/document.xml": document}).items():
            # A fixed date: equal texts are equal files.
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part, zipfile.ZIP_DEFLATED)
    return held.getvalue()


def as_docx(documents: DataFrame, name: str, text: str) -> DataFrame:
    """``path, content``: each document as the bytes of a .docx file, for tables of files."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [docx_bytes(t) for t in frame["text"]]})

    return (documents.select(F.concat(F.col(name).cast("string"), F.lit(".docx")).alias("path"), F.col(text).alias("text"))
            .mapInPandas(run, "path string, content binary"))


def _read_docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, reasons = [], []
        for content in frame["content"]:
            try:
                texts.append(docx_text(content))
                reasons.append(None)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as error:
                texts.append(None)
                reasons.append(f"unreadable docx: {error}")
        yield pd.DataFrame({"path": frame["path"], "text": texts, "reason": reasons})


def _sources(spark: SparkSession, source: str | list[str]) -> list[str]:
    if isinstance(source, list):
        return [p for p in source if p.lower().endswith(TEXT_TYPES)]
    if isinstance(source, str) and path_exists(spark, source):
        return [source]
    raise ValueError(f"neither a folder, a file nor a list of files: {source!r}")


def _files(spark: SparkSession, wanted: list[str], without: list[str], others: dict[str, tuple[int, int]], kind: str,
           *columns: str) -> DataFrame:
    """The given columns of the files of one type in folders (not in their subfolders), or of single files.

    Only files of the type are opened, and their content only if it is asked for. Without any, folders are not listed again.
    """
    any_case = "*." + "".join(f"[{c}{c.upper()}]" for c in kind)
    # Spark skips files without a byte, which ``without`` names.
    empty = [(p, bytearray()) for p in without if p.lower().endswith(f".{kind}")]
    files = spark.createDataFrame(empty, "path string, content binary")
    n, size = others.get(f".{kind}", (0, 0))
    if n:
        found = spark.read.format("binaryFile").option("pathGlobFilter", any_case).load(wanted).select("path", "content")
        # Spark reckons a small file as one of 4 MB, which makes a task of every 30.
        tasks = max(-(-n // FILES_OF_TASK), size // BYTES_OF_TASK, 2 * spark.sparkContext.defaultParallelism)
        files = files.unionByName(found.coalesce(tasks))
    return files.select(*columns)


def _of_type(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.lower(F.col("path")).endswith(f".{kind}"))


def load_files(plain: DataFrame, docx: DataFrame, pdf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents ``filename, text``, errors ``path, reason``) of files by type: ``path, content``, for PDF ``path`` alone.

    Of files with the same name the last path wins among the readable ones. A file without content is an error.
    """
    as_text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = plain.select("path", as_text.alias("text"), F.when(as_text.isNull(), "not UTF-8").alias("reason"))
    docx = docx.select("path", F.coalesce("content", F.lit("").cast("binary")).alias("content")).mapInPandas(
        _read_docx, "path string, text string, reason string")
    pdf = pdf.select("path", F.lit(None).cast("string").alias("text"), F.lit("no PDF reader").alias("reason"))
    # Read once; who wins a name is decided on paths alone, and only the losers' paths meet the texts.
    read = stage(plain.unionByName(docx).unionByName(pdf).withColumn("filename", file_name(F.col("path"))), "files")
    good = read.where(F.col("text").isNotNull())
    winners = (good.groupBy("filename").agg(F.max("path").alias("winner"), F.count("*").alias("n")).where("n > 1"))
    losers = stage(good.select("filename", "path").join(winners, "filename").where("path <> winner").select("path"), "losers")
    return (good.join(losers, "path", "left_anti").select("filename", "text"),
            read.where(F.col("reason").isNotNull()).select("path", "reason"))


def write_text_files(texts: DataFrame, text: str, folder: str) -> None:
    """One .txt file per row in a new folder: the text and a line end; null is the empty text.

    Where the folder is mounted, tasks write the files themselves: Spark's writer starts processes for the rights of every file.
    Names come from the rows' places in ``texts``, which should be a table as it is read, so a task that is repeated writes the
    same files.
    """
    spark = texts.sparkSession
    local = local_path(spark, folder)
    if local is None:
        spread(texts.select(text)).write.option("maxRecordsPerFile", 1).text(folder)
        return
    os.makedirs(local)
    named = texts.select(F.monotonically_increasing_id().alias("place"),
                         F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(*(column.to_pylist() for column in batch.columns)):
                with open(f"{local}/{place}.txt", "wb") as file:
                    file.write(content)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    spread(named).mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


def load_file_table(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bulk_load`` of a table ``path, content``, where files are rows and not small files in a folder."""
    files = files.select("path", "content")
    return load_files(_of_type(files, "txt"), _of_type(files, "docx"), _of_type(files, "pdf").select("path"))


def bulk_load(spark: SparkSession, source: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents ``filename, text``, errors ``path, reason``).

    Unsupported types are skipped; a file that cannot be read becomes an error row. Of files with the
    same name the last path wins among the readable ones.
    """
    wanted = _sources(spark, source)
    # The driver asks for the length of every file: once, for all types.
    listed = [empty_files(spark, w) for w in wanted]
    without, others = [p for empty, _ in listed for p in empty], {}
    for ending, (n, size) in (x for _, by_ending in listed for x in by_ending.items()):
        others[ending] = others.get(ending, (0, 0))[0] + n, others.get(ending, (0, 0))[1] + size
    return load_files(*(_files(spark, wanted, without, others, kind, *columns) for kind, columns in
                        (("txt", ("path", "content")), ("docx", ("path", "content")), ("pdf", ("path",)))))
