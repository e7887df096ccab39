from __future__ import annotations

import tracemalloc

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from portfolia.operators import documents as docs, layout

TEXTS = st.text(alphabet=st.sampled_from("ab \n"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(5, 60), st.integers(0, 4))
def test_chunk_invariants(text, size, overlap):
    chunks = docs.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    # Chunks cover the text in order, and neighbours share at most the overlap.
    at, end = 0, 0
    for i, c in enumerate(chunks):
        low = 0 if i == 0 else max(at + 1, end - overlap)
        spots = [p for p in range(low, end + 1) if text.startswith(c, p)]
        assert spots
        at, end = spots[-1], spots[-1] + len(c)
    if text:
        assert text.endswith(chunks[-1])


def _plain(text, size, overlap, separators):
    """The cutting rule, one text and one chunk at a time."""
    chunks, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            for sep in separators:
                at = text.rfind(sep, start + overlap, stop)
                if at > start + overlap:
                    stop = at + len(sep)
                    break
        chunks.append((start, text[start:stop]))
        if stop == len(text):
            break
        back = max(stop - overlap, start + 1)
        hits = [(text.find(sep, back, stop), len(sep)) for sep in separators]
        fit = [at + n for at, n in hits if at >= 0 and at + n < stop]
        start = fit[0] if fit else stop if any(at >= 0 for at, _ in hits) else back
    return chunks


MIXED = st.text(alphabet=st.sampled_from("aé漢\U0001F600 \n"), max_size=120)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | MIXED, max_size=6), st.integers(3, 30), st.integers(0, 2),
       st.sampled_from([("\n\n", " "), (" ",), ("é漢", "\n"), ()]))
def test_whole_batches_are_cut_as_single_texts_are(texts, size, overlap, separators):
    array = pa.array([None, *texts], pa.string()).slice(1)
    spans = docs._spans(array, size, overlap, separators)
    own, number, start, _, chars = spans
    got = list(zip(own.tolist(), number.tolist(), (start - chars.start[own]).tolist(), docs._texts_at(array, spans).to_pylist(),
                   strict=True))
    assert got == [(i, n, at, c) for i, t in enumerate(texts) for n, (at, c) in enumerate(_plain(t or "", size, overlap, separators))]


def test_memory_of_cutting_does_not_follow_the_batch():
    """An Arrow batch of 16 MB of text is cut with a fraction of its size beside it."""
    batch = pa.RecordBatch.from_arrays([pa.array(["word é " * 2000] * 1000)], names=["t"])
    tracemalloc.start()
    for rows in docs._byte_slices(batch, 0):
        docs._texts_at(rows.column(0), docs._spans(rows.column(0), 4000, 400, docs.SEPARATORS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 15 << 20 and peak < 40 << 20, peak


def test_chunks_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 9, "x", [1]), (2, None, None, None), (3, "", "z", [])],
                               "id int, raw_text string, chunk_src string, l array<int>")
    rows = docs.chunk_text(df, size=10, overlap=2).orderBy("chunk_no").collect()
    assert {(r.id, r.chunk_src, tuple(r.l)) for r in rows} == {(1, "x", (1,))} and len(rows) > 3


def test_chunks_prefer_blank_lines():
    text = "a" * 50 + "\n\n" + "b" * 30 + " " + "c" * 30
    first, *rest = docs.split_text(text, 90, 5)
    assert first == "a" * 50 + "\n\n" and rest[-1].endswith("c" * 30)
    assert docs.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_long_document_is_whole(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([("d", text)], "doc_id string, raw_text string")
    rows = docs.chunk_text(df).orderBy("chunk_no").collect()
    assert all(len(r.chunk) <= 4000 for r in rows)
    assert set(" ".join(r.chunk for r in rows).split()) == set(text.split())


def test_parse_html(spark):
    html = ("<html><head><title>A &amp; B</title></head><body><script>x='<p>'</script><nav>menu</nav>"
            "<h2>Head</h2><p>One<br>two &lt;3</p><!-- gone --><ul><li>x<li>y</ul></body></html>")
    row = docs.parse_documents(spark.createDataFrame([(html,)], "html string")).first()
    assert row.title == "A & B"
    assert row.content == "## Head\n\nOne\ntwo <3\n\nx\ny"


def test_extract_fields(spark):
    rows = [("a", "Insurer: Acme Mutual.\nEffective 2021-05-17"), ("b", "Underwritten by Z Ltd\neffective from 3 march 2020"),
            ("c", "nothing"), ("d", "x" * 5000 + "\nInsurer: Late Co\n")]
    df = spark.createDataFrame(rows, "relative_path string, raw_text string")
    got = {r.relative_path: (r.company, r.date) for r in docs.extract_fields(df).collect()}
    assert got == {"a": ("Acme Mutual", "2021-05"), "b": ("Z Ltd", "2020-03"), "c": (None, None),
                   "d": ("Late Co", None)}
    head = {r.relative_path: r.company for r in docs.extract_fields(df, head_chars=3000).collect()}
    assert head["d"] is None and head["a"] == "Acme Mutual"


def test_batch_extractor(spark):
    df = spark.createDataFrame([("a", "one two")], "relative_path string, raw_text string")
    out = docs.extract_fields_with(
        df, lambda b: b.assign(company=b.raw_text.str.split().str[0])[["relative_path", "company"]],
        "relative_path string, company string")
    assert out.first().company == "one"


def test_chunk_table(spark):
    df = spark.createDataFrame([("p/q.txt", "Insurer: A\nEffective 2020-01-01\n" + "word " * 2000)],
                               "relative_path string, raw_text string")
    rows = docs.build_chunk_table(df, docs.extract_fields(df)).collect()
    assert len(rows) > 1 and {r.document for r in rows} == {"q.txt"} and {r.company for r in rows} == {"A"}
    assert rows[0].document_type == ["INSURANCE_DOCS"]


def test_layout_of_nested_lists_and_tables(spark):
    page = """<html><head><title>T &amp; t</title><style>p {}</style></head><body><nav><ul><li>menu</ul></nav>
<h1>Top</h1><p>One<p>two <b>bold</b>&nbsp;&lt;3
<ul><li>a<ul><li>a1<li>a2<ol><li>first</li><li>second</ol></li></ul><li>b <p>more</p></ul>
<table><thead><tr><th>Name<th>Sum</tr></thead><tr><td>x<td>1<tr><td>y<br>z</td><td><ul><li>p<li>q</ul></td></tr></table>
<!-- gone <p> --><h2>End</h2>tail < 5 <script>var a = "<p>";"""
    df = spark.createDataFrame([(1, page, "c"), (2, None, "c"), (3, "", "c")], "id int, html string, key string")
    got = {r.id: r for r in layout.parse_layout(df).collect()}
    assert got[1].title == "T & t" and (got[2].title, got[2].content, got[3].content) == (None, None, "")
    assert got[1].content == "\n".join([
        "# Top", "", "One", "", "two bold <3", "", "- a", "  - a1", "  - a2", "    1. first", "    2. second", "- b more", "",
        "Name | Sum", "x | 1", "y z | - p; - q", "", "## End", "", "tail < 5"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<ul>", "</ul>", "<ol>", "<li>", "</li>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<p>",
                                 "</p>", "<h2>", "</h2>", "<br>", "<b>", "</div>", "w", " x ", "<", ">", "<!-- ", "&amp;"]), max_size=30))
def test_layout_takes_any_order_of_tags(tokens):
    """No order of tags fails, no word is lost outside comments, and lines are clean."""
    page = "".join(tokens)
    text = layout.layout(page)
    assert "\n\n\n" not in text and "\x01" not in text and "\x02" not in text
    if "<!--" not in page and "<w" not in page:
        assert text.count("w") == tokens.count("w")
