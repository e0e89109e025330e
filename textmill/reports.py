"""Reports of a pipeline's result as JSON, Markdown or HTML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict
from html import escape
from pathlib import Path
from textwrap import indent
from typing import TYPE_CHECKING

from .operators.stats import RECOMMENDATIONS, warning_flags
from .types import PLACE, Chunk

if TYPE_CHECKING:
    from .plans.pipeline import PipelineResult

TITLE = "Textmill Diagnostics Report"
NOTHING = "Nothing needs to be changed."
_SENTENCE = dict(RECOMMENDATIONS)


def recommended(result: PipelineResult) -> list[str]:
    s = result.stats
    seen = warning_flags(result.chunk_table).first() if result.scored else None
    holds = {
        "duplicates": s.duplicate_ratio > 0.1,
        "low_quality": s.low_quality_chunk_count > 0,
        "small_chunks": s.total_chunks > 0 and s.average_chunk_size < 80,
        "boilerplate": bool(seen and seen.boilerplate),
        "long_chunks": bool(seen and seen.too_long),
    }
    return [_SENTENCE[name] for name, yes in holds.items() if yes]


def serialized_chunks(result: PipelineResult) -> Iterator[dict]:
    """Every chunk as the reports show it, one partition after another in order; no more
    than two partitions are on the driver at once."""
    rows = result.chunk_table.orderBy("index")
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if result.scored:
            yield asdict(Chunk.of(r))
        else:
            yield {"text": r.text, "tokens": len(r.text.split()), "score": None, "warnings": [], **{c: r[c] for c in PLACE}}


def summary(c: dict) -> str:
    parts = {"Score": c["score"], "Tokens": c["tokens"], "Warnings": ", ".join(c["warnings"]) or "none", "Source": c["source_document"], "Index": c["chunk_index"], "Offsets": f"{c['start_offset']}..{c['end_offset']}"}
    return "  ".join(f"{k}: {v}" for k, v in parts.items())


def _figures(result: PipelineResult) -> dict[str, str]:
    s = result.stats
    return {
        "Total documents": str(s.total_documents),
        "Total chunks": str(s.total_chunks),
        "Average chunk size": f"{s.average_chunk_size:.2f}",
        "Duplicate ratio": f"{s.duplicate_ratio:.2%}",
        "Low-quality chunks": str(s.low_quality_chunk_count),
    }


def as_json(result: PipelineResult) -> Iterator[str]:
    head = json.dumps({"stats": asdict(result.stats), "warnings": result.warnings, "recommendations": recommended(result), "chunks": []}, indent=2)
    yield head.removesuffix("[]\n}") + "["
    between = ""
    for c in serialized_chunks(result):
        yield between + "\n" + indent(json.dumps(c, indent=2), "    ")
        between = ","
    yield "\n  ]\n}" if between else "]\n}"


def as_markdown(result: PipelineResult) -> Iterator[str]:
    bullets = lambda items: "\n".join(f"- {i}" for i in items)
    sections = {
        "Stats": bullets(f"{k}: {v}" for k, v in _figures(result).items()),
        "Warnings": bullets(result.warnings or ["None"]),
        "Recommendations": bullets(recommended(result) or [NOTHING]),
    }
    yield "\n\n".join([f"# {TITLE}", *(f"## {k}\n\n{v}" for k, v in sections.items()), "## Chunks\n\n"])
    for i, c in enumerate(serialized_chunks(result), 1):
        yield f"### Chunk {i}\n\n- {summary(c)}\n\n```text\n{c['text']}\n```\n\n"


_STYLE = "body{font:16px/1.5 sans-serif;margin:2rem auto;max-width:60rem}td,th{padding:.3rem 1rem;text-align:left}pre{background:#eee;padding:1rem;white-space:pre-wrap}"


def as_html(result: PipelineResult) -> Iterator[str]:
    items = lambda xs: "<ul>" + "".join(f"<li>{escape(x)}</li>" for x in xs) + "</ul>"
    rows = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in _figures(result).items())
    body = {"Stats": f"<table>{rows}</table>", "Warnings": items(result.warnings or ["None"]), "Recommendations": items(recommended(result) or [NOTHING]), "Chunks": ""}
    head = f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{TITLE}</title><style>{_STYLE}</style></head>'
    yield f"{head}<body><h1>{TITLE}</h1>\n" + "\n".join(f"<h2>{k}</h2>\n{v}" for k, v in body.items())
    for i, c in enumerate(serialized_chunks(result), 1):
        yield f"<section><h3>Chunk {i}</h3><p>{escape(summary(c))}</p><pre>{escape(c['text'])}</pre></section>\n"
    yield "</body></html>\n"


WRITERS: dict[str, Callable[[PipelineResult], Iterator[str]]] = {"": as_json, ".json": as_json, ".md": as_markdown, ".markdown": as_markdown, ".html": as_html, ".htm": as_html}


def save(result: PipelineResult, path: str) -> None:
    """Write in the format of the path's suffix, chunk by chunk; folders are made as
    needed. The file is the driver's; nothing but what is being written is held there."""
    target = Path(path)
    writer = WRITERS.get(target.suffix.lower())
    if writer is None:
        raise ValueError(f"no report has the format {target.suffix}")
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as f:
        f.writelines(writer(result))
