"""Documents and search (items 33, 84, 104-108)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from portfolia import bindings as b
from portfolia.operators import documents as docs, layout, search
from portfolia.plans.registry import query, sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The same layout rules, one element and one heading level at a time.
LAYOUT = [(r"(?s)<!--.*?-->", "")]
LAYOUT += [(rf"(?is)<{e}\b.*?</{e}\s*>", "") for e in ("head", "script", "style", "nav", "footer", "noscript")]
LAYOUT += [(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)]
LAYOUT += [
    (r"(?i)</?(p|div|article|section|main|header|ul|ol|table|tr|blockquote|h[1-6]|body|html)\b[^>]*>", "\n\n"),
    (r"(?i)<(br|li)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", ""),
]
SPACES = [(r"[ \t\r]+", " "), (r" ?\n ?", "\n"), (r"\n\n\n+", "\n\n"), (r"^\s+|\s+$", "")]


def _regex_chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return expr


def _entity_chain(expr: str) -> str:
    for entity, char in docs.ENTITIES:
        expr = f"replace({expr}, {_quoted(entity)}, {_quoted(char)})"
    return expr


PAGES = f"""
SELECT page_id, url,
  trim({_entity_chain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) AS title,
  {_regex_chain(_entity_chain(_regex_chain('html', LAYOUT)), SPACES)} AS content
FROM pages"""


@query("parse_documents", PAGES)
def _parse(spark, d):
    return docs.parse_documents(b.table(spark, d, "pages")).drop("html")


# The given pages have lists in their menus only, so that both ways read them alike.
@query("parse_layout", PAGES)
def _layout(spark, d):
    return layout.parse_layout(b.table(spark, d, "pages")).drop("html")


# The documents carry no insurer or date, so a header with both is put before the whole
# text: ISO dates, worded dates, and some documents without either.
HEADED_COLUMNS = [
    "doc_id",
    "concat(source, '/', CAST(doc_id AS STRING), '.txt') AS relative_path",
    "concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Insurer: ', upper(lang), ' Mutual ',"
    " CAST(doc_id % 7 AS STRING), '\n') END, CASE WHEN doc_id % 3 = 0 THEN"
    " concat('Effective date 20', lpad(CAST(doc_id % 25 AS STRING), 2, '0'), '-',"
    " lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-01\n')"
    " WHEN doc_id % 3 = 1 THEN concat('Effective from 3 ', CASE WHEN doc_id % 2 = 0 THEN 'March' ELSE 'October' END,"
    " ' 20', lpad(CAST(doc_id % 25 AS STRING), 2, '0'), '\n') ELSE '' END, '\n', text) AS raw_text",
]


def headed(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").selectExpr(*HEADED_COLUMNS)


HEADED = "SELECT " + ", ".join(HEADED_COLUMNS) + " FROM documents"
FIELDS = """
SELECT relative_path,
  nullif(trim(regexp_extract(raw_text, '(?i)(?:insurer|insured by|underwritten by):?[ ]+([^\n.;,]+)', 1)), '')
    AS company,
  coalesce(nullif(regexp_extract(raw_text, '(?i)effective[^\n]{0,40}?([0-9]{4}-[0-9]{2})', 1), ''),
    nullif(regexp_replace(regexp_replace(
      regexp_extract(raw_text, '(?i)effective[^\n]{0,40}?((March|October)[ ]+[0-9]{4})', 1),
      'March[ ]+([0-9]{4})', '\\1-03'), 'October[ ]+([0-9]{4})', '\\1-10'), '')) AS date
FROM headed"""


@query("extract_fields", f"WITH headed AS ({HEADED}) {FIELDS}")
def _extract(spark, d):
    return docs.extract_fields(headed(spark, d))


@query("join_doc_fields", f"""WITH headed AS ({HEADED}), fields AS ({FIELDS})
SELECT h.doc_id, h.relative_path, h.raw_text, f.company, f.date
FROM headed h JOIN fields f ON f.relative_path = h.relative_path""")
def _join(spark, d):
    rows = headed(spark, d)
    return docs.join_doc_fields(rows, docs.extract_fields(rows))


def chunks_sql(rows: str, size: int = docs.CHUNK_SIZE, overlap: int = docs.CHUNK_OVERLAP) -> str:
    """The cutting rule said in SQL: ``steps`` has one row per key and chunk, each found from the one before it."""
    def stop(s: str) -> str:
        window = f"substr(t, {s} + {overlap + 2}, {size - overlap - 1})"
        last = [f"strpos(reverse({window}), {sep})" for sep in ("chr(10) || chr(10)", "' '")]
        return f"""CASE WHEN {s} + {size} >= length(t) THEN length(t) WHEN {last[0]} > 0 THEN {s} + {size + 1} - {last[0]}
      WHEN {last[1]} > 0 THEN {s} + {size + 1} - {last[1]} ELSE {s} + {size} END"""

    return f"""steps AS (
  SELECT key, t, 0 AS no, 0 AS s, {stop('0')} AS e FROM ({rows}) r WHERE length(t) > 0
  UNION ALL
  SELECT key, t, no + 1, begin, {stop('begin')} FROM (
    SELECT *, CASE WHEN lines > 0 AND back + lines + 1 < e THEN back + lines + 1
        WHEN blanks > 0 AND back + blanks < e THEN back + blanks
        WHEN lines = 0 AND blanks = 0 THEN back ELSE e END AS begin
    FROM (SELECT *, strpos(substr(t, back + 1, e - back), chr(10) || chr(10)) AS lines,
        strpos(substr(t, back + 1, e - back), ' ') AS blanks
      FROM (SELECT *, greatest(e - {overlap}, s + 1) AS back FROM steps WHERE e < length(t)) x) y) z
)"""


@query("chunk_text", f"""WITH RECURSIVE {chunks_sql('SELECT doc_id AS key, text AS t FROM documents')}
SELECT key AS doc_id, CAST(no AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, substr(t, s + 1, e - s) AS chunk
FROM steps""")
def _chunk(spark, d):
    return docs.chunk_text(b.documents(spark, d)).select("doc_id", "chunk_no", "start", "chunk")


@query("build_chunk_table", f"""WITH RECURSIVE headed AS ({HEADED}), fields AS ({FIELDS}),
{chunks_sql('SELECT relative_path AS key, raw_text AS t FROM headed', 1000, 100)}
SELECT key AS relative_path, company, date, ['INSURANCE_DOCS'] AS document_type, split_part(key, '/', 2) AS document,
  CAST(no AS INTEGER) AS chunk_no, substr(t, s + 1, e - s) AS text
FROM steps JOIN fields ON relative_path = key""")
def _chunk_table(spark, d):
    return docs.build_chunk_table(headed(spark, d), size=1000, overlap=100)


@query("chunk_coverage", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, true AS all_in_place, true AS all_within_size,
  true AS no_gap, length(text) <= 4000 AS one_chunk
FROM documents WHERE length(text) > 0""")
def _coverage(spark, d):
    """Every chunk is what stands at its place in the text, and the chunks cover the text without a gap."""
    rows = b.documents(spark, d).select("doc_id", "raw_text")
    chunks = docs.chunk_text(rows.withColumn("whole", F.col("raw_text")))
    size = F.length("chunk")
    checked = chunks.select(
        "doc_id", "chunk_no", "start", size.alias("size"),
        (F.substring("whole", F.col("start") + 1, size) == F.col("chunk")).alias("in_place"),
        F.length("whole").alias("length"))
    per_doc = checked.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"),
        F.min("in_place").alias("all_in_place"), (F.max("size") <= docs.CHUNK_SIZE).alias("all_within_size"),
        F.max("length").alias("length"))
    reach = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(True).alias("whole")), lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
        (acc["whole"] & (s["start"] <= acc["end"])).alias("whole")))
    return per_doc.select(
        "doc_id", reach["end"].cast("long").alias("covered"), "all_in_place", "all_within_size",
        reach["whole"].alias("no_gap"), (F.size("spans") == 1).alias("one_chunk"))


@query("fn_flatten", """
SELECT broker_id, index, value FROM (
  SELECT concat('BRK', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS broker_id,
    unnest([0, 1]) AS index, unnest([r_name, n_name]) AS value
  FROM nation JOIN region ON n_regionkey = r_regionkey) x""")
def _flatten(spark, d):
    from portfolia.functions.scalar import flatten_rows

    return flatten_rows(b.brokers(spark, d).select("broker_id", "territory"), "territory")


BM25 = r"""
WITH d AS (SELECT doc_id, source, [w for w in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if w <> ''] AS words FROM documents),
q AS (SELECT item_id AS query_id, [w for w in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if w <> ''] AS words FROM benchmark),
corpus AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avg_len FROM d),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(words) AS term FROM q) GROUP BY 1, 2),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM dt, corpus GROUP BY term, n),
scored AS (SELECT query_id, dt.doc_id, source,
    round(sum(qtf * w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg_len))), 6) AS score
  FROM qt JOIN dt USING (term) JOIN idf USING (term) JOIN d ON d.doc_id = dt.doc_id, corpus
  GROUP BY 1, 2, 3)
SELECT query_id, doc_id, score, source, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) r
WHERE rank <= 3"""


@query("search_chunks", BM25)
def _search(spark, d):
    corpus = b.table(spark, d, "documents").select("doc_id", "text", "source")
    queries = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.with_metadata(search.search_chunks(corpus, queries, k=3), corpus, "source")


@query("search_vectors", """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label AS query_id, i, avg(v) AS v FROM x GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY 1),
xn AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM x GROUP BY 1),
s AS (SELECT c.query_id, x.vec_id, round(sum(c.v * x.v) / max(qn.norm) / max(xn.norm), 6) AS score
  FROM x JOIN c USING (i) JOIN qn ON qn.query_id = c.query_id JOIN xn ON xn.vec_id = x.vec_id GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
WHERE rank <= 10""")
def _vectors(spark, d):
    rows = b.table(spark, d, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.search_vectors(corpus, search.label_centroids(rows), k=10)
