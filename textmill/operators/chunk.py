"""Documents to chunk rows, with the place of each chunk in its document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunking
from ..functions.text import W_WIDE, let

_PLACES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _found(text: Column, chunks: Column) -> Column:
    """Chunks with their offsets: each is searched for from one past the start of the
    one before. start is -1 where a chunk isn't found."""
    empty = F.array().cast(_PLACES)
    first = F.struct(F.lit(-1).cast("long").alias("prev"), empty.alias("out"))

    return let(text, lambda text: F.aggregate(chunks, first, _step(text), lambda acc: acc["out"]))


def _step(text: Column):
    def step(acc: Column, x: Column) -> Column:
        at = F.call_function("locate", x, text, (acc["prev"] + 2).cast("int")).cast("long") - 1
        place = F.struct(x.alias("text"), at.alias("start"), (at + F.char_length(x)).alias("end"))
        return F.struct(at.alias("prev"), F.concat(acc["out"], F.array(place)).alias("out"))

    return step


def place_chunks(text: str, chunks: list[str]) -> list[tuple[str, int, int]]:
    """Offsets in Python, for texts whose line breaks the chunks have lost.

    A chunk that isn't a substring is searched for as a run of words; failing that,
    it gets the empty span at the cursor."""
    runs = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    names = [r[0] for r in runs]
    out, cursor = [], 0
    for chunk in chunks:
        start = text.find(chunk, cursor)
        span = (start, start + len(chunk)) if start >= 0 else (cursor, cursor)
        wanted = chunk.split()
        if start < 0 and wanted:
            for i in range(len(runs) - len(wanted) + 1):
                if runs[i][1] >= cursor and names[i] == wanted[0] and names[i : i + len(wanted)] == wanted:
                    span = (runs[i][1], runs[i + len(wanted) - 1][2])
                    break
        out.append((chunk, *span))
        cursor = span[0] + 1
    return out


@F.pandas_udf(_PLACES)
def _placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, chunks in batches:
        yield pd.Series([None if t is None else [{"text": c, "start": a, "end": b} for c, a, b in place_chunks(t, list(cs))] for t, cs in zip(text, chunks)])


def with_offsets(text: Column, chunks: Column) -> Column:
    """Array of (text, start, end) for an array of chunks, in code points. Python is
    asked only where a chunk spans a line break and so can't be found as it is."""
    lined = text.rlike(f"[{W_WIDE}]|  ")
    searched = _placed(F.when(lined, text), F.when(lined, chunks))
    return F.coalesce(searched, _found(text, chunks))


def chunk_rows(docs: DataFrame, *, chunk_size: int = 512, overlap: int = 64, preserve_headings: bool = True, mode: str = "word", tokenizer=None, single_line: bool = False, offsets: bool = True) -> DataFrame:
    """One row per chunk: all columns of docs but `text`, then chunk_index, text and,
    with offsets, start_offset and end_offset. single_line: the texts are cleaned, so
    they have no line breaks. Null texts have no chunks."""
    text = F.col("text")
    if mode == "word" and single_line:
        chunks = chunking.chunk_line(text, chunk_size, overlap)
    else:
        chunks = chunking.chunk(text, chunk_size, overlap, preserve_headings, mode=mode, tokenizer=tokenizer)
    keep = [c for c in docs.columns if c != "text"]
    if not offsets:
        rows = docs.select(*keep, F.posexplode(chunks).alias("chunk_index", "text"))
        return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))
    cut = docs.withColumn("_chunks", chunks)
    found = _found(text, F.col("_chunks")) if single_line else with_offsets(text, F.col("_chunks"))
    rows = cut.select(*keep, F.posexplode(found).alias("chunk_index", "_c"))
    return rows.select(*keep, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("_c.text").alias("text"), F.col("_c.start").alias("start_offset"), F.col("_c.end").alias("end_offset"))
