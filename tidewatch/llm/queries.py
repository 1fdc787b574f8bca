"""The registered queries of this subpackage and their SQL counterparts; each query reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidewatch.llm.bpe import read_ranks, round_trip
from tidewatch.llm import (compact_windows, crf, curriculum, piecewise, prefix_trie, reply_trees, rule_cascade, spelling, tag_paths,
                           toxicity, voronoi)
from tidewatch.llm.chosen_path import near_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
        FROM documents)),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(generate_series(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS shingle FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_n, count(*) AS c
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (both_n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sized s JOIN least l USING (doc_id)
"""


@query(NEAR_SQL)
def op10_chosen_path_near_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose three-word shingle sets are linked at 85 % or more."""
    return near_groups(table(spark, folder, "documents"), width=3, percent=85)


def vocabulary(spark: SparkSession) -> dict[bytes, int]:
    return read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op7_bpe_rank_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the token ids of every whole text and of the bytes they decode to."""
    return round_trip(table(spark, folder, "documents"), vocabulary(spark), public_tokenizers.PATTERN)


@query()
def op8_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a curriculum of the given weights takes of every document, and when it takes them first."""
    planned = curriculum.plan(table(spark, folder, "documents"))
    return planned.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        F.coalesce(F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]), F.lit(0).cast("long")).alias("taken"),
        F.array_min(F.transform("copies", lambda c: c["position"])).alias("position")).orderBy(F.asc_nulls_last("position"), "doc_id")


@query()
def op1_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole text by a conditional random field over its lines."""
    return crf.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_segment_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text by its significant maximum-scoring segments."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op5_compact_window_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the passages of 50 words or more that they share with earlier ones."""
    return compact_windows.repeated(table(spark, folder, "documents"))


@query()
def op6_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every whole text, of the text edited at its end, and their likeness to each other and to the next text's."""
    rows = piecewise.beside_next(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       piecewise.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       piecewise.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


@query()
def op9_tag_path_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return tag_paths.extract(table(spark, folder, "pages"))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
written AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS body,
    CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE '~' || role END AS name
  FROM turns),
texts AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS l,
    sum(4 + length(name) + 2 + length(body) + 8)::BIGINT AS formatted_chars FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM texts
"""
HARD_TEXT = "\\### Assistant: </turn> ok"


@query(CHAT_SQL)
def op2_reply_tree_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one that quotes the template, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)],
                                 "conv_id long, turn long, role string, text string")
    written = reply_trees.conversations(reply_trees.as_tree(rows.unionByName(hard)))
    read = written.select("conv_id", "formatted", reply_trees.read_back(F.col("formatted")).alias("turns"),
                          reply_trees.learned(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


TOP_SQL = r"""
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM points q JOIN points p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs) WHERE rank <= 20
"""


@query(TOP_SQL)
def op3_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors of highest inner product to every vector whose id is divisible by 20."""
    return voronoi.top_k(table(spark, folder, "embeddings"))


#: The table of the polynomial of crc32.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(data: str) -> str:
    """SQL for the unsigned crc32 of a list of bytes, beside the one row of crc_table."""
    return (f"xor(list_reduce([4294967295::BIGINT] || {data}, "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


TRIE_SQL = rf"""
WITH {CRC_TABLE_SQL},
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS p, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 100 AS base, {crc_sql("list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)")} % 6 AS h
  FROM (SELECT DISTINCT c FROM turns), crc_table),
placed AS (
  SELECT v.c, 0 AS part, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
  UNION ALL SELECT v.c, 1, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, r, x FROM placed),
paths AS (
  SELECT c, 0 AS d, '' AS k, 0 AS chars FROM convs
  UNION ALL SELECT c, d, sha256(to_json(list({{'r': r, 'x': x}}) OVER up)::VARCHAR), length(x) FROM numbered
    WINDOW up AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY d, k),
linked AS (  -- each node with its parent, on the path of its least conversation
  SELECT n.*, q.k AS parent FROM nodes n LEFT JOIN paths q ON q.c = n.conv_id AND q.d = n.d - 1),
fans AS (SELECT d - 1 AS d, parent AS k, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT l.*, coalesce(f.n, 0) AS n_children FROM linked l LEFT JOIN fans f USING (d, k)),
sums AS (
  SELECT q.d, q.k, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars)::BIGINT AS saved_tokens
  FROM own o JOIN paths q ON q.c = o.conv_id AND q.d <= o.d GROUP BY 1, 2),
ends AS (
  SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s
  FROM (SELECT c, d, k FROM paths QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY 1, 2)
SELECT o.conv_id, o.d::BIGINT AS depth, a.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.s, sha256('')) AS ends_sha256
FROM own o JOIN sums s USING (d, k) LEFT JOIN ends e USING (d, k) LEFT JOIN nodes a ON a.d = o.d - 1 AND a.k = o.parent
"""


@query(TRIE_SQL)
def op11_band_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix that rebuilt conversations share, with what it saves."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


RULES_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM texts),
often AS (SELECT r, max(n) AS most FROM (SELECT r, x, count(*) AS n FROM words GROUP BY 1, 2) GROUP BY 1),
triples AS (SELECT *, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM triples WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, x, y, z) > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
counted AS (
  SELECT doc_id, t, w, l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(most, 0) AS most
  FROM texts LEFT JOIN again USING (r) LEFT JOIN often USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (
  base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_dup_lines > 30 * len(l)
  OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g'))
  OR 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > 20 * n_words OR 100 * most > 20 * n_words
  OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 90 * len(l)
  OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(l)) AS kept
FROM based
"""


@query(RULES_SQL)
def op12_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of every whole text, and whether it passes all quality rules."""
    return rule_cascade.judged(table(spark, folder, "documents"))


SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (
  SELECT run, n, {crc_sql('''flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END))''')} AS h
  FROM runs, crc_table),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cuts AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, left(word, i::INT) AS a, substr(word, i::INT + 1) AS z FROM cuts),
outs AS (SELECT word, n, left(word, i::INT) AS a, substr(word, i::INT + 2) AS z FROM cuts WHERE i < length(word)),
links AS (
  SELECT x.word, y.word AS other, y.n AS m FROM outs x JOIN outs y USING (a, z) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN outs y USING (a, z)
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN outs y USING (a, z)),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM links GROUP BY 1),
named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL SELECT c.word, n.word, n.form FROM chain c JOIN named n ON n.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""


@query(SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words at one code point from each other, and the frequent form of each."""
    return spelling.variants(table(spark, folder, "documents"))
