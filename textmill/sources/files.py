"""Raw texts, files and folders as sources.

The driver lists paths, which Spark's own listing would thin out (it passes over names
that begin with an underscore); executors read and decode the files, which must be in a
file system that all of them see."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_DEPTH = 8
SUFFIXES = frozenset(["", ".txt", ".md", ".markdown", ".html", ".htm", ".log", ".json", ".csv"])

SCHEMA = "source_document string, doc_order array<string>, text string"


def supported(path: Path) -> bool:
    return path.suffix.lower() in SUFFIXES


def list_files(root: Path, max_depth: int = MAX_DEPTH) -> list[Path]:
    """Files below root, names that begin with a dot passed over, down to max_depth
    folders. Folders that can't be read and broken links are skipped."""
    found: list[Path] = []

    def walk(folder: Path, depth: int) -> None:
        try:
            entries = list(os.scandir(folder))
        except OSError:
            return
        for e in entries:
            if e.name.startswith("."):
                continue
            path = folder / e.name
            try:
                if e.is_dir():
                    if depth < max_depth:
                        walk(path, depth + 1)
                elif e.is_file():
                    found.append(path)
            except OSError:
                continue

    walk(root, 0)
    return sorted(found)


def decode(data: bytes) -> str:
    """UTF-8 with unreadable bytes replaced; all line ends become line feeds."""
    return data.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            with open(row.path, "rb") as f:
                text = decode(f.read())
            yield pd.DataFrame({"source_document": [row.source_document], "doc_order": [row.doc_order], "text": [text]})


def read_files(spark: SparkSession, files: list[Path], root: Path | None) -> DataFrame:
    """The files' texts, named by their path below root or by their own name."""
    names = [f.relative_to(root).as_posix() if root else f.name for f in files]
    rows = [(str(f), n, n.split("/")) for f, n in zip(files, names)]
    paths = spark.createDataFrame(rows, "path string, source_document string, doc_order array<string>")
    return paths.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4))).mapInPandas(_read, SCHEMA)


def _existing(source: str) -> Path | None:
    try:
        path = Path(source)
        return path if path.exists() else None
    except (OSError, ValueError):  # too long, or not a path at all
        return None


def load(spark: SparkSession, source: str) -> DataFrame:
    """A file, the supported files of a folder or, failing both, the string itself."""
    if not isinstance(source, str):
        raise TypeError("the source must be a string")
    path = _existing(source)
    if path is not None and path.is_file():
        return read_files(spark, [path], None)
    if path is not None and path.is_dir():
        return read_files(spark, [f for f in list_files(path) if supported(f)], path)
    return spark.createDataFrame([("<text>", ["<text>"], source)], SCHEMA)


def stream_files(source: str) -> tuple[list[Path], Path | None]:
    """The files of a stream in order, and the folder that their names leave out."""
    path = _existing(source)
    if path is None:
        raise FileNotFoundError(f"no such file or folder: {source}")
    if path.is_file():
        return [path], None
    if path.is_dir():
        return [f for f in list_files(path) if supported(f)], path
    raise ValueError("a stream's source must be a file or a folder")
