"""The operators on the given tables, one query each, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bin_sharding import sharded
from millrace.llm.circulant_minhash import minhash_components
from millrace.llm.collision_search import nearest
from millrace.llm.common import stored
from millrace.llm.fill_in_middle import fill_in_middle, restored
from millrace.llm.html_tree import main_text
from millrace.llm.language_gru import languages
from millrace.llm.mask_search import ranked_search
from millrace.llm.prefix_tree_join import jaccard_components
from millrace.llm.quality_ratio import quality_rules
from millrace.llm.sequence_packing import packed
from millrace.llm.source_mixing import mixed, pieces_for, source_sizes, tempered_weights, with_position
from millrace.llm.suffix_dedup import repeated_spans
from millrace.llm.toxicity_fm import toxicity


def _read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def op1_collision_search(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id 20 divides."""
    return nearest(_read(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


#: Shares of the sources: their sizes to this power.
FLATTEN = 0.7


def op2_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """The copies of one epoch, mixed to flattened shares of the sources, in order."""
    docs = _read(spark, directory, "documents")
    sizes = stored(source_sizes(docs))
    weights = tempered_weights(sizes, FLATTEN)
    return with_position(mixed(docs, weights), pieces=pieces_for(sizes)).select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "n_copies", "copy", "position"
    )


OP2_SQL = """
WITH s AS (
  SELECT source, CAST(sum(greatest(strlen(coalesce(text, '')), 1)) AS DOUBLE) AS size FROM documents GROUP BY source),
r AS (SELECT source, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size AS rate FROM s),
m AS (
  SELECT source, CAST(greatest(1, ceil(rate / 8.0)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 8.0)) AS mean
  FROM r),
c AS (
  SELECT source, parts, list(cdf ORDER BY j) AS cdf FROM (
    SELECT source, parts, j, sum(exp(-mean) * pow(mean, j) / factorial(CAST(j AS INTEGER)))
      OVER (PARTITION BY source ORDER BY j) AS cdf
    FROM m, range(0, 30) AS t(j)) GROUP BY source, parts),
d AS (
  SELECT doc_id, source, cdf,
    CAST('0x' || substr(md5(concat_ws(':', 'mix', doc_id, i)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, documents.source, cdf, unnest(range(1, parts + 1)) AS i
        FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source)),
n AS (
  SELECT doc_id, source, sum(len(list_filter(cdf, lambda x: x <= u))) AS n_copies FROM d GROUP BY doc_id, source),
k AS (SELECT doc_id, source, n_copies, unnest(range(0, CAST(n_copies AS BIGINT))) AS copy FROM n),
o AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'mix:order', doc_id, copy)), 1, 13) AS BIGINT) AS place FROM k)
SELECT doc_id, source, CAST(n_copies AS BIGINT) AS n_copies, CAST(copy AS BIGINT) AS copy,
  CAST(row_number() OVER (ORDER BY place, doc_id, copy) - 1 AS BIGINT) AS position
FROM o
"""


def op3_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    """Components of documents that share 75 of 100 five-word shingles."""
    return jaccard_components(_read(spark, directory, "documents"), k=5, percent=75)


def _components_sql(k: int, percent: int, more: str) -> str:
    """Sizes and components of documents linked by shingles, with further columns."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k} - 1], ' ')) END) AS g
    FROM w)),
n AS (SELECT w.r, doc_id, count(g) AS n FROM w LEFT JOIN s ON w.r = s.r GROUP BY w.r, doc_id),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.r = x JOIN n AS ny ON ny.r = y
  WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
t(r, m) AS (SELECT r, r FROM n UNION SELECT t.r, l.y FROM t JOIN l ON l.x = t.m),
c AS (SELECT t.r, min(n.doc_id) AS component_id FROM t JOIN n ON n.r = t.m GROUP BY t.r)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, {more} FROM n JOIN c ON c.r = n.r
"""


OP3_SQL = _components_sql(5, 75, "(SELECT count(*) FROM l WHERE x = n.r) AS n_links")


def op4_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes, equal texts together."""
    return sharded(_read(spark, directory, "documents"))


def op5_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Base counts and the verdict on every document; trusted are those of quality 1."""
    trusted = _read(spark, directory, "labels").filter("quality = 1")
    return quality_rules(_read(spark, directory, "documents"), trusted).select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op6_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Passages of 50 words or more that stand in the documents more than once."""
    return repeated_spans(_read(spark, directory, "documents"), span=50, head=10).drop("crc")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT doc_id, pos, array_to_string(words[pos + 1:pos + 50], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS pos FROM w WHERE len(words) >= 50)),
f AS (
  SELECT doc_id, pos, passage, first_value(doc_id) OVER o AS d0, first_value(pos) OVER o AS p0
  FROM p WINDOW o AS (PARTITION BY passage ORDER BY doc_id, pos)),
m AS (SELECT *, d0 <> doc_id OR pos - p0 >= 50 AS removed FROM f),
g AS (SELECT *, bool_or(removed) OVER (PARTITION BY passage) AS again FROM m),
k AS (SELECT doc_id, pos, removed FROM g WHERE removed OR (again AND doc_id = d0 AND pos = p0)),
i AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, removed ORDER BY pos) AS prev FROM k),
j AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR pos > prev + 50 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, removed ORDER BY pos) AS island FROM i)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word,
  CAST(max(pos) + 50 - min(pos) AS BIGINT) AS n_words, removed
FROM j GROUP BY doc_id, removed, island
"""


def op8_packing(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as tokens in sequences of 1024."""
    return packed(_read(spark, directory, "documents"))


def op7_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    return toxicity(_read(spark, directory, "documents"), _read(spark, directory, "labels"))


def op9_language(spark: SparkSession, directory: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return languages(_read(spark, directory, "documents"))


def op10_main_text(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of every page."""
    return main_text(_read(spark, directory, "pages"))


def op11_fill_in_middle(spark: SparkSession, directory: str) -> DataFrame:
    """The fill-in-the-middle form of every document, as hashes of it and its text."""
    found = fill_in_middle(_read(spark, directory, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS x,
    CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS y, CAST('0x' || h[25:32] AS BIGINT) % 100 AS z
  FROM u),
p AS (
  SELECT doc_id, text, n, z, array_to_string(units[1:least(x, y)], '') AS pre,
    array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS mid,
    array_to_string(units[greatest(x, y) + 1:], '') AS suf
  FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END
    AS form
  FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""


def op12_minhash(spark: SparkSession, directory: str) -> DataFrame:
    """Components of documents that share 80 of 100 two-word shingles, the first kept."""
    return minhash_components(_read(spark, directory, "documents"), k=2, percent=80)


OP12_SQL = _components_sql(2, 80, "n.doc_id = c.component_id AS kept")


def op13_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 documents of highest score for every item of the benchmark."""
    return ranked_search(_read(spark, directory, "documents"), _read(spark, directory, "benchmark"), k=10)


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM t WHERE len(terms) > 0),
f AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS r, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
c AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_search": op1_collision_search,
    "op2_source_mixing": op2_source_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_main_text": op10_main_text,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash": op12_minhash,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
