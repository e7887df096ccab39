"""The registered queries of this package and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portfolia.llm import (
    bpe, chat, license, lm, merkle, minhash, packing, quality, resample, rules, toxicity, vectors)
from portfolia.llm.common import read, remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


CONFLICT = "</s>[INST] ok [/INST]"


@query("op1_chat_formatting", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, contains(text, '</s>') OR contains(role, '</s>') OR contains(role, ' [/INST]') AS clash,
    role || text AS both_texts FROM rows
), sized AS (
  SELECT *, length(role) + length(text) + 24 + CASE WHEN clash THEN
    (length(both_texts) - length(replace(both_texts, chr(92), '')))
    + (length(both_texts) - length(replace(both_texts, '<s>', ''))) / 3
    + (length(both_texts) - length(replace(both_texts, '</s>', ''))) / 4
    + (length(both_texts) - length(replace(both_texts, '[INST]', ''))) / 6
    + (length(both_texts) - length(replace(both_texts, '[/INST]', ''))) / 7 ELSE 0 END AS chars
  FROM marked
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, rendered, read back and digested."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return chat.digests(chat.format_chat(rows.unionByName(added)))


@query("op7_bpe_forced_boundary")
def op7_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, as digests."""
    return bpe.encode_texts(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests_only=True)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt outside the held-out third."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fifth."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces_of(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their four-word shingles."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt outside the held-out fifth."""
    return lm.score(read(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)


@query("op5_embedding_near_dedup")
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of equal label at a cosine of 0.93 or more."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return vectors.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text."""
    return license.scan_texts(read(spark, sf_dir, "documents"))


# crc32 byte by byte from its table, which is made from the polynomial.
CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) AS c
    FROM range(256) t(i)) x
)"""


def crc_of(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; needs ``tab`` of crc_table."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"""xor(list_reduce({octets}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"""


LOWER_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op11_importance_resampling", f"""
WITH {CRC}, docs AS (SELECT doc_id, {LOWER_WORDS} AS words FROM documents),
of_docs AS (SELECT doc_id, unnest(words) AS f FROM docs),
of_target AS (SELECT unnest({LOWER_WORDS}) AS f FROM benchmark),
counted AS (
  SELECT f, sum(s) AS s, sum(t) AS t FROM (
    SELECT f, count(*) AS s, 0 AS t FROM of_docs GROUP BY f
    UNION ALL SELECT f, 0, count(*) FROM of_target GROUP BY f) x GROUP BY f
), hashed AS (SELECT f, s, t, {crc_of('f')} % 10000 AS bucket FROM counted, crc_table),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT
    AS gain FROM buckets
), weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS w
  FROM of_docs JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark by single words."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _value(column: str, text: str = "") -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_value, ('doc_id', 'source', 'lang', 'n_chars')), _value('text', text)])})"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE {CRC}, rows AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {crc_of("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
      ELSE {_leaf('text')} END AS now
  FROM documents, crc_table
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM rows
), nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3
), roots AS (SELECT tree, h FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM roots) AS n, h FROM roots
  UNION ALL
  SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i))
  FROM tops WHERE n > 1 GROUP BY level, i // 3
), both_levels AS (
  SELECT tree, level, i, n, h FROM nodes WHERE n > 1
  UNION ALL SELECT -1, level, i, n, h FROM tops WHERE n > 1
), walk AS (
  -- one row per document and step: in its source's tree, then (tree -1) in the tree of all sources
  SELECT doc_id, leaf, CASE WHEN n > 1 THEN tree ELSE -1 END AS tree, tree AS home, 0 AS level,
    CASE WHEN n > 1 THEN i ELSE tree END AS i, n, now AS h, '' AS proof, false AS done FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, CASE WHEN any_value(b.n) <= 3 THEN -1 ELSE w.tree END, w.home,
    CASE WHEN any_value(b.n) <= 3 AND w.tree >= 0 THEN 0 ELSE w.level + 1 END,
    CASE WHEN any_value(b.n) <= 3 AND w.tree >= 0 THEN w.home ELSE w.i // 3 END, 0,
    sha256(string_agg(CASE WHEN b.i = w.i THEN w.h ELSE b.h END, '' ORDER BY b.i)),
    w.proof || coalesce(string_agg(CASE WHEN b.i <> w.i THEN b.h END, '' ORDER BY b.i), ''), false
  FROM walk w JOIN both_levels b ON b.tree = w.tree AND b.level = w.level AND b.i // 3 = w.i // 3
  GROUP BY w.doc_id, w.leaf, w.home, w.tree, w.level, w.i, w.h, w.proof
), ends AS (
  SELECT doc_id, leaf, home, arg_max(h, strlen(proof) * 1000 + (CASE WHEN tree = -1 THEN 500 ELSE 0 END) + level) AS folded,
    arg_max(proof, strlen(proof)) AS proof FROM walk GROUP BY doc_id, leaf, home
)
SELECT doc_id, leaf, roots.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM tops WHERE n = 1) AS verified
FROM ends JOIN roots ON roots.tree = ends.home""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, with every proof folded from a leaf that is computed anew."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    parts = []
    for r in rules.RULES:
        if r.least is not None:
            parts.append(f"100 * {r.part} >= {r.least} * {r.whole}")
        if r.most is not None:
            parts.append(f"100 * {r.part} <= {r.most} * {r.whole}")
    return " AND ".join(parts)


STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@query("op13_quality_rules", rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^ 	-]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines,
    list_filter(list_transform(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), lambda w: trim(w, '.,;:!?"''()')),
      lambda w: w IN ({STOPS})) AS stops
  FROM texts
), places AS (
  SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w, i
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split) x
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM places) x WHERE k > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) x GROUP BY 1
), counts AS (
  SELECT split.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, coalesce(n, 0) AS n_repeat_words,
    CAST(len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) AS BIGINT) AS n_letter_words,
    CAST(len(stops) AS BIGINT) AS n_stop_words, CAST(len(list_distinct(stops)) AS BIGINT) AS n_stop_kinds,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	-]*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[ 	-]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, 1 AS one
  FROM split LEFT JOIN repeated USING (doc_id)
)
SELECT * EXCLUDE (one), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_rules_sql()} AS kept
FROM counts""")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdicts of every document."""
    return rules.judge(read(spark, sf_dir, "documents"))
