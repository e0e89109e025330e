import json

import pytest

import textmill
from textmill import Pipeline, reports
from textmill.sources import files
from textmill.sources.tables import documents
from textmill.streaming.batches import batched, start


@pytest.fixture
def folder(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())

    write("a/b.txt", "alpha beta gamma")
    write("a.txt", "delta epsilon zeta")
    write("_draft.md", "a draft that is read")
    write(".hidden.txt", "hidden")
    write(".git/x.txt", "hidden")
    write("B.MD", "caf\xe9".encode("latin-1"))
    write("plain", "one\r\ntwo\rthree")
    write("image.png", b"\x89PNG")
    write("/".join("d" * 8) + "/deep.txt", "deep enough")
    write("/".join("d" * 9) + "/deeper.txt", "too deep")
    (tmp_path / "broken.txt").symlink_to(tmp_path / "nowhere")
    return tmp_path


def test_sources(spark, folder):
    rows = files.load(spark, str(folder)).orderBy("doc_order").collect()
    text = {r.source_document: r.text for r in rows}
    assert [r.source_document for r in rows] == ["B.MD", "_draft.md", "a/b.txt", "a.txt", "d/d/d/d/d/d/d/d/deep.txt", "plain"]
    assert text["B.MD"] == "caf�" and text["plain"] == "one\ntwo\nthree"
    assert files.load(spark, str(folder / "image.png")).first().source_document == "image.png"
    assert files.load(spark, "x" * 5000).first().source_document == "<text>"
    with pytest.raises(TypeError):
        documents(spark.range(1), "id", "id")


def test_run_on_text(spark):
    seen = []
    r = Pipeline().run("Hello world. Hello world.", progress=lambda *a: seen.append(a))
    assert r.chunks == ["Hello world. Hello world."]
    assert (r.stats.total_documents, r.stats.total_chunks, r.stats.duplicate_ratio) == (1, 1, 0.0)
    assert r.scored_chunks[0].source_document == "<text>" and r.scored_chunks[0].end_offset == 25
    assert seen == [("clean", 1, 1), ("dedupe", 0, 1), ("dedupe", 1, 1), ("score", 0, 1), ("score", 1, 1)]


def test_run_on_folder_and_options(spark, folder):
    (folder / "copy.txt").write_text("Alpha  beta gamma")
    r = Pipeline().run(str(folder))
    assert r.stats.total_documents == 7 and r.stats.total_chunks == 6
    assert r.stats.duplicate_ratio == pytest.approx(1 / 7)
    assert [c.source_document for c in r.chunk_metadata][:3] == ["B.MD", "_draft.md", "a/b.txt"]
    bare = Pipeline(clean=False, dedupe=False, score=False, chunk_size=2, overlap=1).run("a\nb c\n\nd")
    assert bare.scored_chunks == [] and bare.chunks == ["a b", "b c", "d"]
    assert [(m.start_offset, m.end_offset) for m in bare.chunk_metadata] == [(0, 3), (2, 5), (7, 8)]
    empty = Pipeline().run("  ")
    assert empty.warnings == ["no_chunks_created"] and empty.stats.total_chunks == 0 and empty.stats.average_chunk_size == 0.0
    with pytest.raises(ValueError):
        Pipeline(chunk_size=0).run("x")
    with pytest.raises(TypeError):
        Pipeline().run(3)


def test_reports(spark, tmp_path):
    r = Pipeline().run("Tom & <Jerry> \"x\" 'y' &lt;b&gt;")
    r.save_report(str(tmp_path / "deep" / "r.json"))
    data = json.loads((tmp_path / "deep" / "r.json").read_text())
    assert set(data) == {"stats", "warnings", "recommendations", "chunks"} and data["chunks"][0]["chunk_index"] == 0
    r.save_report(str(tmp_path / "r.md"))
    md = (tmp_path / "r.md").read_text()
    assert md.startswith(f"# {reports.TITLE}") and all(f"## {s}" in md for s in ("Stats", "Warnings", "Recommendations", "Chunks"))
    r.save_report(str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert page.startswith("<!doctype html>") and "Tom &amp; &quot;x&quot;" in page
    r.save_report(str(tmp_path / "bare"))
    assert json.loads((tmp_path / "bare").read_text())["stats"]["total_chunks"] == 1
    with pytest.raises(ValueError):
        r.save_report(str(tmp_path / "r.xml"))
    unscored = Pipeline(score=False).run("a b")
    assert next(reports.serialized_chunks(unscored))["tokens"] == 2
    assert any("larger chunk_size" in s for s in reports.recommended(r))


def test_stream_of_files(spark, tmp_path):
    for i, text in enumerate(["one two", "One  two", "three four", "one two", "five six", "THREE four", "seven"]):
        (tmp_path / f"{i}.txt").write_text(text)
    seen = []
    out = list(Pipeline().stream(str(tmp_path), batch_size=3, progress=lambda *a: seen.append(a)))
    assert [r.chunks for r in out] == [["one two", "three four"], ["five six"], ["seven"]]
    assert [r.stats.total_documents for r in out] == [3, 3, 1]
    assert out[0].stats.duplicate_ratio == pytest.approx(1 / 3) and out[1].stats.duplicate_ratio == 0.0
    assert ("clean", 7, 7) in seen and ("dedupe", 1, 3) in seen
    with pytest.raises(FileNotFoundError):
        next(Pipeline().stream(str(tmp_path / "none")))
    with pytest.raises(ValueError):
        next(Pipeline().stream(str(tmp_path), batch_size=0))


def test_stream_forms_agree(spark, tmp_path):
    texts = ["one two", "One  two", "three four", "one two", "five six", "THREE four", "seven", "!!!"]
    rows = [(str(i), i, t, i // 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "source_document string, doc_order long, text string, batch_id long")
    chunks, stats = batched(Pipeline(), docs)
    got = [(r.batch_id, r.text) for r in chunks.orderBy("index").collect()]
    assert got == [(0, "one two"), (0, "three four"), (1, "five six"), (2, "seven"), (2, "!!!")]
    assert {r.batch_id: r.total_chunks for r in stats.collect()} == {0: 2, 1: 1, 2: 2}
    source = tmp_path / "in"
    for b in range(3):
        docs.where(f"batch_id = {b}").drop("batch_id").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(docs.drop("batch_id").schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    start(Pipeline(), stream, str(tmp_path / "out"), str(tmp_path / "seen"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(t for _, t in got)


def test_public_names():
    assert all(hasattr(textmill, n) for n in textmill.__all__) and len(textmill.__all__) == 15
