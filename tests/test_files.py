import numpy as np

from litweave.plans.library import ingest_dir
from litweave.plans.ingest import chunk_rows, parse_papers
from litweave.sources import papers as paper_source
from litweave.sources.store import all_chunks, all_vectors
from litweave.streaming.incremental import ingest_stream


def decoder():
    def decode(content):  # inside, so that it travels to the workers by value
        spans = [{"page": 0, "spans": [{"text": t, "size": 12.0}]} for t in content.decode().split("|")]
        return {"creation_date": "D:2021", "lines": spans}

    return decode


decode = decoder()


def library(folder):
    (folder / "sub").mkdir()
    (folder / "good.pdf").write_bytes(b"A title of some length|" + b"|".join(b"line %d of the body text" % i for i in range(90)))
    (folder / "sub" / "short.pdf").write_bytes(b"Another title|one line")
    (folder / "broken.pdf").write_bytes(b"\xff\xfe\x00")
    (folder / "other.txt").write_bytes(b"not read")


def test_slices_are_bounded_by_bytes():
    sizes = [5, 5, 100, 0, 3, 9, None, 11, 10]
    contents = [None if n is None else b"x" * n for n in sizes]
    got = list(paper_source._slices(contents, 10))
    assert got == [(0, 2), (2, 3), (3, 5), (5, 7), (7, 8), (8, 9)]
    assert list(paper_source._slices([], 10)) == []
    rng = np.random.default_rng(1)
    many = [b"x" * int(n) for n in rng.integers(0, 30, 500)]
    runs = list(paper_source._slices(many, 64))
    assert [i for a, b in runs for i in range(a, b)] == list(range(500))
    assert all(b - a == 1 or sum(map(len, many[a:b])) <= 64 for a, b in runs)


def test_a_damaged_file_is_an_error_row(spark, tmp_path):
    library(tmp_path)
    for batch_bytes in (1, 1 << 20):
        got = paper_source.decode_files(paper_source.pdf_files(spark, str(tmp_path)), decode, batch_bytes).collect()
        errors = {r.stem: r.error for r in got}
        assert errors.keys() == {"good", "short", "broken"}
        assert errors["good"] is errors["short"] is None and errors["broken"].startswith("UnicodeDecodeError")
        assert {r.stem: len(r.lines) for r in got} == {"good": 91, "short": 2, "broken": 0}


def test_a_directory_in_one_call(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    library(source)
    chunks, vectors = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    provider = lambda texts: [[float(len(t))] for t in texts]
    for _ in range(2):
        done = ingest_dir(spark, str(source), decode, chunks, vectors, provider)
        report = {r.title: (r.year, r.chunks) for r in done.report.collect()}
        stored = all_chunks(spark, chunks).count()
        assert report["broken"] == (0, 0) and report.keys() >= {"broken"} and len(report) == 3
        assert tuple(done.totals.first()) == (3, stored) and stored > 2
        assert [r.source.rsplit("/", 1)[1] for r in done.errors.collect()] == ["broken.pdf"]
        assert all_vectors(spark, vectors).count() == stored


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    done = ingest_dir(spark, str(tmp_path / "in"), decode, str(tmp_path / "chunks"))
    assert done.report.count() == done.errors.count() == 0 and tuple(done.totals.first()) == (0, 0)
    assert all_chunks(spark, str(tmp_path / "chunks")).count() == 0


def test_files_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    library(source)
    files = paper_source.pdf_stream(spark, str(source), maxFilesPerTrigger=1)
    path = str(tmp_path / "chunks")
    ingest_stream(paper_source.decode_files(files, decode), path, str(tmp_path / "c")).awaitTermination()
    whole = chunk_rows(parse_papers(paper_source.decode_files(paper_source.pdf_files(spark, str(source)), decode)))
    stored = all_chunks(spark, path)
    assert stored.count() == whole.count() and whole.select(*stored.columns).exceptAll(stored).count() == 0
