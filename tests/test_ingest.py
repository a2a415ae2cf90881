import random

from pyspark.sql import functions as F

from litweave import schema
from litweave.operators import structure
from litweave.plans.ingest import chunk_rows, ingest_report, ingest_totals, parse_papers
from litweave.sources import papers as paper_source
from litweave.sources.store import add_chunks, all_chunks, count, list_papers, read_table


def papers(spark, docs):
    """docs: {paper_id: [(page, text, size)]}"""
    rows = [
        (pid, f"/lib/{pid}.pdf", pid, None, [(p, i, t, s) for i, (p, t, s) in enumerate(lines)])
        for pid, lines in docs.items()
    ]
    return spark.createDataFrame(rows, schema.PAPERS)


def chunk_list(spark, lines, **kw):
    got = chunk_rows(parse_papers(papers(spark, {"p": lines}), **kw)).orderBy("chunk_index")
    return got.collect()


def body(lengths, pages=None):
    pages = pages or [0] * len(lengths)
    return [(p, chr(97 + i % 26) * n, 10.0) for i, (n, p) in enumerate(zip(lengths, pages))]


def test_chunking_table(spark):
    assert [len(c.text) for c in chunk_list(spark, body([99] * 7))] == [699]
    two = chunk_list(spark, body([399, 399], [0, 1]))
    assert [len(c.text) for c in two] == [799, 119]
    assert [(c.page, c.start_page) for c in two] == [(0, 0), (0, 1)]
    three = chunk_list(spark, body([399, 399, 679], [0, 1, 2]))
    assert [len(c.text) for c in three] == [799, 799, 119]
    assert [(c.page, c.start_page) for c in three] == [(0, 0), (0, 2), (0, 2)]
    assert [len(c.text) for c in chunk_list(spark, body([399, 399, 678], [0, 1, 2]))] == [799, 798]
    assert [len(c.text) for c in chunk_list(spark, body([2000]))] == [2000, 119]


def fold(lines, size, overlap):
    """The rule in plain Python: (page, start page, text) of each chunk."""
    out, buf, page, start = [], "", 0, None
    for p, t in lines:
        if not buf:
            page = p
        if start is None:
            start = p
        buf += t + "\n"
        if len(buf) >= size:
            out.append((page, start, buf.strip()))
            buf, start = (buf[-overlap:] if overlap else ""), None
    if buf.strip():
        out.append((page, lines[-1][0] if start is None else start, buf.strip()))
    return out


def test_chunking_matches_the_plain_rule(spark):
    rng = random.Random(11)
    for size, overlap in ((800, 120), (50, 20), (50, 0)):
        docs = {}
        for d in range(40):
            n = rng.randint(1, 60)
            docs[f"p{d}"] = [
                (i // 9, ("w" * rng.randint(1, 200) + " é") if rng.random() < 0.9 else "x", 10.0)
                for i in range(n)
            ]
        got = {}
        for c in chunk_rows(parse_papers(papers(spark, docs), size, overlap)).collect():
            got.setdefault(c.paper_id, []).append((c.chunk_index, c.page, c.start_page, c.text))
        for pid, lines in docs.items():
            want = fold([(p, t) for p, t, _ in lines], size, overlap)
            assert [x[1:] for x in sorted(got[pid])] == want


def test_fold_blocks_do_not_change_the_result(spark, monkeypatch):
    lines = body([50] * 300)
    want = [c.text for c in chunk_list(spark, lines)]
    monkeypatch.setattr(structure, "_FOLD_BLOCK", 7)
    assert [c.text for c in chunk_list(spark, lines)] == want


def test_sections(spark):
    lines = [
        (0, "before the first heading, a long enough body line", 10.0),
        (0, "Abstract", 10.0),
        (0, "1 Introduction", 10.0),
        (0, "some body text that is long, long, long, long, long, long", 10.0),
        (1, "1 Introduction", 10.0),
        (1, "more body text that is long, long, long, long, long, long", 10.0),
        (1, "References", 10.0),
    ]
    got = chunk_list(spark, lines)
    assert [(c.section, c.text.split()[0]) for c in got] == [
        ("_front", "before"), ("1 Introduction", "some"), ("1 Introduction", "more"),
    ]
    assert [c.chunk_id for c in got] == ["p_0", "p_1", "p_2"]


def test_title_and_body_size(spark):
    lines = [
        (0, "arXiv:2301.12345v1", 20.0),
        (0, "A Study of", 16.0),
        (0, "Ann Author∗", 16.0),
        (0, "small print", 8.0),
        (0, "Long Titles", 16.0),
        (1, "PAGE TWO IS LARGER", 30.0),
        (1, "b" * 50, 10.0),
        (1, "c" * 50, 9.0),
    ]
    p = papers(spark, {"p": lines, "empty": []})
    got = {r.paper_id: r for r in parse_papers(p).select("paper_id", "title", "year").collect()}
    assert (got["p"].title, got["p"].year) == ("A Study of Long Titles", 2023)
    assert (got["empty"].title, got["empty"].year) == ("empty", 0)
    sizes = dict(p.select("paper_id", structure.body_size(F.col("lines"))).collect())
    assert sizes == {"p": 10.0, "empty": 10.0}


def test_report_counts_papers_without_chunks(spark):
    parsed = parse_papers(papers(spark, {"a": body([10]), "b": []}))
    report = ingest_report(parsed)
    assert {r.paper_id: r.chunks for r in report.collect()} == {"a": 1, "b": 0}
    assert tuple(ingest_totals(report).first()) == (2, 1)


def test_span_rows_and_nested_spans_agree(spark):
    spans = [
        ("p", 0, 0, 0, 0, "  Hello", 10.04), ("p", 0, 0, 0, 1, " world ", 12.06),
        ("p", 0, 0, 1, 0, "   ", 10.0), ("p", 0, 1, 0, 0, "next", 9.0),
    ]
    rows = paper_source.lines_of_span_rows(spark.createDataFrame(spans, schema.SPANS))
    got = [(r.text, r.size) for r in rows.orderBy("line_no").collect()]
    assert got == [("Hello world", 12.1), ("next", 9.0)]
    nested = spark.createDataFrame(
        [([(0, [("  Hello", 10.04), (" world ", 12.06)]), (0, [("   ", 10.0)]), (0, [("next", 9.0)])],)],
        "s array<struct<page:int,spans:array<struct<text:string,size:double>>>>",
    )
    lines = nested.select(F.inline(paper_source.lines_of_spans(F.col("s")))).collect()
    assert [(r.text, r.size) for r in lines] == got


def test_pdf_scan_and_decoder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"Title A|body")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"-")
    (tmp_path / "c.txt").write_bytes(b"no")

    def decode(content):
        parts = [] if content == b"-" else content.decode().split("|")
        spans = [{"page": 0, "spans": [{"text": t, "size": 12.0}]} for t in parts]
        return {"creation_date": "D:2020", "lines": spans}

    files = paper_source.pdf_files(spark, str(tmp_path))
    got = paper_source.decode_files(files, decode)
    rows = {r.stem: r for r in parse_papers(got).join(got.select("paper_id", "stem"), "paper_id").collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["b"].title, rows["b"].year, rows["b"].chunks) == ("b", 0, [])
    assert rows["a"].year == 2020
    import hashlib

    assert rows["a"].paper_id == hashlib.md5(str(tmp_path / "a.pdf").encode()).hexdigest()[:12]


def test_store_is_idempotent(spark, tmp_path):
    path, vec = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    assert count(all_chunks(spark, path)) == 0
    rows = chunk_rows(parse_papers(papers(spark, {"a": body([900, 900]), "b": body([10])})))
    provider = lambda texts: [[float(len(t))] for t in texts]
    for _ in range(2):
        add_chunks(rows, path, vec, provider)
    stored = all_chunks(spark, path)
    assert count(stored) == rows.count() == read_table(spark, vec, schema.VECTORS).count()
    assert count(all_chunks(spark, path, F.col("paper_id") == "b")) == 1
    assert {r.paper_id: r.title for r in list_papers(stored).collect()}.keys() == {"a", "b"}


def test_partition_count_does_not_matter(spark, sf):
    import driver_tables as inputs

    documents = spark.read.parquet(f"{sf}/documents.parquet")

    def digest(n):
        rows = chunk_rows(parse_papers(inputs.papers_of(documents.repartition(n))))
        return rows.select(F.sum(F.crc32(F.concat_ws("|", *rows.columns).cast("binary")))).first()[0]

    assert digest(1) == digest(7)


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "chunks")
    add_chunks(chunk_rows(parse_papers(papers(spark, {"a": body([10])}))), path)
    all_chunks(spark, path, F.col("year") >= 2012).select("chunk_id", "year").explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(year,2012)" in plan
    assert "ReadSchema: struct<chunk_id:string,year:int>" in plan


def test_ingest_does_not_shuffle(spark, capsys):
    chunk_rows(parse_papers(papers(spark, {"a": body([10])}))).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_span_rows_in_any_order_travel_as_runs(spark):
    rows = [
        ("p", 0, 0, 0, 2, "c", 9.0), ("p", 0, 0, 0, 0, "a", 9.0), ("p", 0, 0, 0, 1, "b", 9.0),
        ("p", 0, 0, 1, 1, "y", 11.0), ("p", 0, 0, 1, 1, "x", 9.0), ("p", 0, 0, 1, 2, "z", None), ("p", 0, 0, 1, None, "0", 9.0),
        ("q", 0, 0, 0, 0, None, 9.0), ("q", 0, 0, 0, 1, " q", float("nan")), ("q", 0, 0, 2, 0, " ", 9.0),
    ] + [("r", 0, 0, k // 20, k % 20, f" {k}", 10.0) for k in range(30_000)]
    spans = spark.createDataFrame(rows, schema.SPANS).coalesce(1)
    found = {(r["paper_id"], r["line_no"]["line"]): r for r in paper_source.lines_of_span_rows(spans).collect()}
    assert [found[k]["text"] for k in (("p", 0), ("p", 1), ("q", 0))] == ["abc", "0xyz", "q"]
    assert found["p", 1]["size"] == 11.0 and len(found) == 3 + 1500
    assert all(found["r", n]["text"] == " ".join(map(str, range(20 * n, 20 * n + 20))) for n in range(1500))
    runs = spans.where("paper_id = 'r'").mapInArrow(
        paper_source._runs, "paper_id string, page int, block int, line int, size double, span int, texts array<string>"
    )
    assert runs.count() < 1510
