"""Report rows of every chunk, not of first ones alone."""

import os

import pytest

from textmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_every_chunk_has_a_report_row(spark):
    key = lambda df: sorted((str(r[0]), r[1]) for r in df.collect())
    chunks = key(catalogue.QUERIES["chunk_documents"](spark, SF).select("doc_id", "chunk_index"))
    assert chunks[-1] and max(k for _, k in chunks) > 0
    assert key(catalogue.QUERIES["report_rows"](spark, SF).select("source_document", "chunk_index")) == chunks
