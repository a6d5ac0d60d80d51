"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayledger.llm import (
    cover_tree, exact_dedup, fm_index, histogram_sort, hyperminhash, infill, letter_trie, line_winnow, packing, pfair, quality, sparse_suffix,
    warc,
)

_BLANK = r"[\x20\x09-\x0D]+"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that occur earlier, one row each; documents without any have no row."""
    passages = sparse_suffix.repeated_passages(_table(spark, folder, "documents"))
    return passages.select("doc_id", "start_word", "n_words", F.sha2(F.regexp_replace("passage", _BLANK, " "), 256).alias("passage_sha256"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_winnow.without_repeated_lines(_table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces(_table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.train(docs, _table(spark, folder, "labels"))
    return quality.scored(docs, model).select(
        F.col("_row.doc_id").alias("doc_id"), (quality.fold("_row.doc_id") == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(_table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = pfair.mixed(_table(spark, folder, "documents"))
    return mix.select("_row.doc_id", "_row.source", F.col("_slot").alias("slot"), F.col("_place").alias("place"),
                      F.col("_source_rank").alias("source_rank"), F.col("_balanced").alias("balanced"))


def op8_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_groups(_table(spark, folder, "documents"))


def op9_cover_tree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, folder, "embeddings"))


def op10_fm_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fm_index.without_repeats(_table(spark, folder, "documents")).drop("kept_text")


def op11_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("_row.text", F.lit(""))
    return histogram_sort.sharded(_table(spark, folder, "documents")).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_letter_trie(spark: SparkSession, folder: str) -> DataFrame:
    return letter_trie.variants(_table(spark, folder, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = infill.restored(infill.transformed(_table(spark, folder, "documents").select("doc_id", "text")))
    return done.select(F.col("_row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def _repeats_sql(tokens: str, size: int) -> str:
    """CTEs: ``t`` (doc_id, w), and ``covered`` (doc_id, q), the numbers from 1 of tokens in a repeated window."""
    return f"""WITH t AS ({tokens}),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + {size - 1}], chr(10)) AS k FROM t, unnest(range(1, len(w) - {size - 2})) u(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, q FROM later, unnest(range(p, p + {size})) u(q))"""


_WORDS_SQL = f"""SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w FROM documents"""
_TRIMMED = f"regexp_replace({{}}, '^{_BLANK}|{_BLANK}$', '', 'g')"

SQL: dict[str, str] = {
    "op1_suffix_array_dedup": _repeats_sql(_WORDS_SQL, sparse_suffix.MIN_WORDS) + """,
runs AS (SELECT doc_id, min(q) AS a, count(*) AS n FROM
  (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS g FROM covered) GROUP BY doc_id, g)
SELECT doc_id, CAST(a - 1 AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words,
  sha256(array_to_string(w[a:a + n - 1], ' ')) AS passage_sha256
FROM runs JOIN t USING (doc_id)""",
    "op2_line_dedup": _repeats_sql(
        f"SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIMMED.format('x')}), lambda x: x <> '') AS w FROM documents",
        line_winnow.MIN_LINES) + f""",
lines AS (SELECT doc_id, i, l[i] AS line, {_TRIMMED.format('l[i]')} <> '' AS solid
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)),
numbered AS (SELECT doc_id, i, line, CASE WHEN solid THEN sum(CAST(solid AS INT)) OVER (PARTITION BY doc_id ORDER BY i) END AS q FROM lines),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS kept FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.q = c.q
  WHERE c.q IS NULL GROUP BY n.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN gone ON t.doc_id = gone.doc_id""",
    "op4_exact_dedup": f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM d WINDOW g AS (PARTITION BY content)""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, array_to_string(list_transform(range(1, 41), lambda i:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
  [strpos('0123456789abcdef', substr(sha1(h), i, 1))]), '') AS bits, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b:
    CAST(substr(bits, 5 * j + b + 1, 1) AS INT) * CAST(2 ** (4 - b) AS INT))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d""",
    "op8_hyperminhash": f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN
  list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id, t.doc_id = min(reach.y) AS kept
FROM t JOIN reach ON reach.x = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
    "op9_cover_tree_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op12_letter_trie": """WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
coded AS (SELECT run, list_concat([4294967295], flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END))) AS b FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM coded, table_),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word
  FROM hashed),
v AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM v, unnest(range(1, length(word) + 1)) u(i)),
longer AS (SELECT DISTINCT cut.word AS a, cut.n AS an, v.word AS b, v.n AS bn FROM cut JOIN v ON cut.rest = v.word),
near AS (SELECT a, an, b, bn FROM longer UNION ALL SELECT b, bn, a, an FROM longer
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS form, max(bn) AS form_n FROM near GROUP BY a),
named AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.a),
chain AS (SELECT word, word AS root FROM named UNION ALL SELECT chain.word, named.form FROM chain JOIN named ON chain.root = named.word WHERE named.form IS NOT NULL)
SELECT named.word, named.n, named.n_near, named.form, named.form_n, chain.root FROM named JOIN chain ON named.word = chain.word
  JOIN named last ON last.word = chain.root WHERE last.form IS NULL""",
    "op13_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', doc_id)) AS h,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
k AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op10_fm_index_dedup": _repeats_sql(_WORDS_SQL, fm_index.WINDOW) + """,
kept AS (SELECT t.doc_id, string_agg(t.w[i], ' ' ORDER BY i) AS kept FROM t, unnest(range(1, len(w) + 1)) u(i)
  LEFT JOIN covered c ON t.doc_id = c.doc_id AND i = c.q WHERE c.q IS NULL GROUP BY t.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN gone ON t.doc_id = gone.doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_array_dedup, op2_line_dedup, op3_packing, op4_exact_dedup, op5_quality_classifier, op6_warc,
             op7_pfair_mix, op8_hyperminhash, op9_cover_tree_topk, op10_fm_index_dedup, op11_histogram_sort,
             op12_letter_trie, op13_fill_in_middle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
