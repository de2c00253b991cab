"""Registered queries of the package: thin calls of the operators over whole tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip_digests
from .centroids import cluster
from .decontaminate import contained_items
from .fill_middle import fill_in_middle, restored
from .ngram_join import jaccard_components
from .packing import pack_documents
from .quality_rules import quality_verdicts
from .secret_scan import scan
from .sharding import shard_by_bytes
from .suffix_dedup import remove_repeats
from .token_files import tokenized_documents
from .tool_calls import link_tool_calls
from .toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).drop("component_key")


TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "summarize": {"text": ("string", True)},
    "lookup": {"key": ("string", True), "strict": ("boolean", True)},
}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is read as a call, every later user turn as the result of the turn before it.

    The table has no tool calls of its own; names, arguments (some with errors) and needs follow from turn and text length.
    """
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    size, kind = F.length("text"), F.col("turn") % 3
    call = lambda at: F.concat(F.lit("c"), at.cast("string"))
    said = turns.filter("role = 'assistant'")
    arguments = (
        F.when(kind == 0, F.when(size % 5 == 0, F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").cast("string").alias("limit")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit")))))
        .when(kind == 1, F.when(size % 7 == 0, F.lit("{ }")).otherwise(F.to_json(F.struct("text"))))
        .otherwise(F.when(size % 3 == 0, F.to_json(F.struct(F.lit(True).alias("strict"), F.col("conv_id").cast("string").alias("key"), F.lit("x").alias("note")))).otherwise(F.lit("{broken")))
    )
    name = F.when(size % 11 == 0, "erase").when(kind == 0, "search").when(kind == 1, "summarize").otherwise("lookup")
    step = F.when(F.col("conv_id") % 10 == 0, F.lit(2)).otherwise(F.lit(-2))
    calls = said.select("conv_id", call(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), name.alias("name"), arguments.alias("arguments"), F.array(call(F.col("turn") + step)).alias("depends_on"))
    results = turns.filter("role = 'user' AND turn >= 2").select("conv_id", call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return link_tool_calls(calls, results, TOOLS)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), span=200)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", dims=64, scale=64).drop("evaluated")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, ids=False)[0]


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"), seed=42)
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_tool_calls": op2_tool_calls,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_packing": op12_packing,
    "op13_fill_middle": op13_fill_middle,
}


def _shingle_ctes(name: str, table: str, key: str) -> str:
    """CTEs ``<name>_words`` and ``<name>`` (key, shingle): distinct 5-word shingles, or the whole sequence of fewer words."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""{name}_words AS (
  SELECT {key}, [w FOR w IN regexp_split_to_array({lower}, '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM {table} WHERE text IS NOT NULL
), {name} AS (
  SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
                                     WHEN len(ws) > 0 THEN ['#' || len(ws) || ' ' || array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM {name}_words
)"""


def _rounds_sql(k: int, rounds: int, dims: int) -> str:
    """CTEs ``c0`` .. ``c<rounds>`` of centroids and ``a0`` .. ``a<rounds>`` of assignments."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({dims} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = {dims} AND {finite})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM kept ORDER BY sha256('1:' || vec_id), q LIMIT {k})",
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(kept.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"d{n} AS MATERIALIZED (SELECT r, c, CAST({distance} AS BIGINT) AS d FROM kept, c{n} c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(
                f"m{n} AS (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{n} JOIN kept USING (r), range(1, {dims + 1}) t(i) GROUP BY c, i), "
                f"f{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{n} GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.q, c.q) AS q FROM c{n} c LEFT JOIN f{n} f ON f.c = c.c)"
            )
    return ",\n".join(parts)


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
WITH RECURSIVE {_shingle_ctes("s", "documents", "doc_id")},
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots ON roots.x = d.doc_id
""",
    "op2_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, length(text) AS size FROM conversations),
calls AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, 'c' || (turn + CASE WHEN conv_id % 10 = 0 THEN 2 ELSE -2 END) AS need,
    CASE WHEN size % 11 = 0 THEN 'erase' WHEN turn % 3 = 0 THEN 'search' WHEN turn % 3 = 1 THEN 'summarize' ELSE 'lookup' END AS name,
    CASE WHEN turn % 3 = 0 THEN CASE WHEN size % 5 = 0 THEN json_object('limit', CAST(turn AS VARCHAR), 'query', text) ELSE json_object('limit', turn, 'query', text) END
         WHEN turn % 3 = 1 THEN CASE WHEN size % 7 = 0 THEN '{}'::JSON ELSE json_object('text', text) END
         WHEN size % 3 = 0 THEN json_object('key', CAST(conv_id AS VARCHAR), 'note', 'x', 'strict', true) END AS arguments,
    CASE WHEN turn % 3 = 2 AND size % 3 <> 0 THEN ['malformed arguments']
         WHEN size % 11 = 0 THEN ['unknown tool']
         WHEN turn % 3 = 0 AND size % 5 = 0 THEN ['type limit']
         WHEN turn % 3 = 1 AND size % 7 = 0 THEN ['missing text']
         WHEN turn % 3 = 2 THEN ['unexpected note'] ELSE CAST([] AS VARCHAR[]) END AS errors
  FROM t WHERE role = 'assistant'
),
bad AS (SELECT DISTINCT a.conv_id FROM calls a JOIN calls b ON b.conv_id = a.conv_id AND b.call_id = a.need WHERE b.turn >= a.turn),
levels AS (
  SELECT conv_id, call_id, 0 AS level FROM calls WHERE conv_id IN (SELECT conv_id FROM bad)
    AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = calls.conv_id AND b.call_id = calls.need)
  UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.need
),
placed AS (
  SELECT c.*, l.level, row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(l.level, 0), c.turn) - 1 AS place
  FROM calls c LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'user' AND turn >= 2)
SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, CAST(p.place AS BIGINT) AS place, CAST(p.level AS INTEGER) AS level,
  CASE WHEN p.conv_id IS NULL THEN ['result without call'] ELSE p.errors END AS errors,
  CAST(json_object('arguments', p.arguments, 'call_id', coalesce(p.call_id, r.call_id), 'errors', CASE WHEN p.conv_id IS NULL THEN ['result without call'] ELSE p.errors END,
    'name', p.name, 'result', r.content) AS VARCHAR) AS message
FROM placed p FULL JOIN results r ON r.conv_id = p.conv_id AND r.call_id = p.call_id
""",
    "op10_decontamination": f"""
WITH {_shingle_ctes("s", "documents", "doc_id")}, {_shingle_ctes("t", "benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
FROM s JOIN t USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
""",
    "op11_centroids": f"""
WITH {_rounds_sql(16, 3, 64)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 a JOIN kept USING (r) JOIN c3 ON c3.c = a.c
""",
    "op13_fill_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(0, 4)] AS hs FROM t),
v AS (SELECT *, len(w) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
  WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b FROM v),
y AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM y
""",
}
