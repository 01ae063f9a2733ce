"""Files: document records, binary documents, page rasters, and result files."""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import constants as K
from folioflow.functions import text as X


def list_documents(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """(path, length) of all files below root with a suffix in any case. Contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", "length")


def read_binaries(spark: SparkSession, root: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of files below root; larger ones are left out before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    return found.select("path", "length", "content")


def missing_files(paths: list[str]) -> list[str]:
    """The local paths that do not exist; http and https addresses are not looked up."""
    return [p for p in paths if urllib.parse.urlsplit(p).scheme not in ("http", "https") and not os.path.exists(p)]


def missing_from(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """wanted(path) without a file in listing(path); addresses are left out."""
    return wanted.where(~F.col("path").rlike("^https?://")).join(listing, "path", "left_anti")


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested documents from JSON with the fixed schema; doc_id is a hash of the file's path and the record.

    NaN and Infinity are read as numbers. Absent and null fields are both null.
    """
    found = spark.read.schema(schemas.DOCUMENT).option("multiLine", multi_line).option("allowNonNumericNumbers", "true").json(path)
    return found.withColumn("doc_id", F.xxhash64(F.col("_metadata.file_path"), F.to_json(F.struct(*found.columns))))


def write_documents(docs: DataFrame, path: str | None = None, source: str | None = None) -> None:
    """One JSON object a line, UTF-8, null fields left out; to path, or beside the source."""
    if path is None and source is None:
        raise ValueError("a path or a source is needed")
    docs.write.mode("overwrite").json(path or translated_path(source))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The translation cache, empty where there is none yet."""
    try:
        return spark.read.schema(schemas.CACHE).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.CACHE)


def write_cache(cache: DataFrame, path: str) -> None:
    """Replaces the cache at path. cache must not read from path: give a new version a new path."""
    cache.write.mode("overwrite").parquet(path)


def read_template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _within(body: bytes | Iterable[bytes], most: int) -> bytes | None:
    """The whole body, or None as soon as it is larger than most bytes."""
    if isinstance(body, bytes):
        return body if len(body) <= most else None
    parts, size = [], 0
    for part in body:
        size += len(part)
        if size > most:
            return None
        parts.append(part)
    return b"".join(parts)


def fetch(urls: DataFrame, download: Callable[[str], tuple[int, bytes | Iterable[bytes], str | None]], max_bytes: int) -> DataFrame:
    """(url, name, content, error) of urls(url), by a function url -> (status, body, name or None).

    Only status 200 counts; names end in .pdf. A body may come in parts: no more of them is read
    than max_bytes allow, and a larger body is an error. The function is an adapter: without a
    network, tests pass one that answers from memory.
    """

    def run(frames):
        import pandas as pd

        for df in frames:
            for url in df["url"]:
                content, name, error = None, None, None
                try:
                    status, body, name = download(url)
                    error = None if status == 200 else f"status {status}"
                    content = _within(body, max_bytes) if error is None else None
                    error = f"over {max_bytes} bytes" if error is None and content is None else error
                except Exception as e:  # noqa: BLE001
                    content, error = None, f"{type(e).__name__}: {e}"
                stem = os.path.splitext(os.path.basename(name or urllib.parse.urlsplit(url).path))[0] or "document"
                yield pd.DataFrame([(url, f"{stem}.pdf", content, error)], columns=["url", "name", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, name string, content binary, error string")


def translated_path(path: str) -> str:
    """Where the translation of a document file goes unless a place is named."""
    return f"{path.removesuffix('.json')}.translated.json"


def result_names(docs: DataFrame, path: str = "path") -> DataFrame:
    """docs with the names of their two results."""
    stem = X.file_stem(path)
    return docs.withColumn("mono", F.concat(stem, F.lit("-mono.pdf"))).withColumn("dual", F.concat(stem, F.lit("-dual.pdf")))


def save_files(files: DataFrame, directory: str) -> None:
    """Writes files(name, content) to a directory that all executors mount; each file appears whole."""

    def save(rows) -> None:
        os.makedirs(directory, exist_ok=True)
        for r in rows:
            part = f"{directory}/.{r.name}.part"
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, f"{directory}/{r.name}")

    files.select("name", "content").foreachPartition(save)


def font_for(lang: str, directory: str) -> str:
    """The path of the font asset of a language."""
    return f"{directory}/{K.FONTS.get(lang.lower(), K.DEFAULT_FONT)}"
