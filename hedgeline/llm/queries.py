"""One query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, cover_tree, licenses, line_runs, multiprobe, packing, pseudo_likelihood, repair, simhash, suffixes, toxicity
from .common import Scratch, small_batches, table

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffixes.dedup_digests(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, Scratch(spark, "packing"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, bpe.digests, bpe.DIGEST_SCHEMA)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, often.k IS NOT NULL AND often.top <> doc_id AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2048)
    return multiprobe.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "neighbours"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2048)
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "cover-tree"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 64)  # an example holds its whole context
    marks = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    return chat.digests(chat.expand(table(spark, sf_dir, "conversations").select(*planted.columns).union(planted)))


ORACLES["op9_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, length('<turn >') + length(chr(10)) * 3 + length('</turn>')
            + length(replace(replace(role, '\', '\\'), '>', '\>')) + length(replace(replace(text, '\', '\\'), '<', '\<')) AS chars FROM turns),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n, sum(chars) OVER w AS so_far
  FROM written WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (WHERE role = 'assistant' OR place = n) AS formatted_chars
FROM placed GROUP BY conv_id"""


@query
def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    conversations = table(spark, sf_dir, "conversations")
    return repair.digests(conversations, repair.damaged(conversations), Scratch(spark, "repair"))


#: Bits of the bytes of a key, the lowest of each byte first, and what CRC-32 makes of them.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen({0}) + 1), lambda i:
  list_transform(range(8), lambda k: ((ascii(substr({0}, i, 1)) >> k::INT) & 1)::BIGINT)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
KEPT = {("start", "s"): "system", ("start", "u"): "us", ("system", "u"): "us", ("us", "a"): "whole", ("whole", "u"): "us"}
FORCED = {"start": "us", "system": "us", "us": "whole", "whole": "us"}


def _cheapest() -> str:
    """Of each state the cheapest edits (cost, audit) from a row on, from those behind it."""
    after = lambda edit, paid, s: f"{{'cost': {paid} + n.{s}.cost, 'audit': '{edit}' || n.{s}.audit}}"
    columns = []
    for state, forced in FORCED.items():
        keeps = "".join(f", CASE WHEN lower(letter) = '{initial}' THEN {after('K', 'cut', to)} END" for (at, initial), to in KEPT.items() if at == state)
        columns.append(f"list_min(list_filter([{after('D', 4, state)}, CASE WHEN letter <> 'x' THEN {after('R', '3 + cut', forced)} END{keeps}], lambda o: o IS NOT NULL)) AS {state}")
    return ", ".join(columns)


def _inserted(rows: str) -> str:
    """With up to two rows inserted before: whatever the state, further ones lead back to it."""
    for _ in range(2):
        rows = "SELECT * REPLACE (" + ", ".join(f"list_min([{s}, {{'cost': 3 + {to}.cost, 'audit': 'I' || {to}.audit}}]) AS {s}" for s, to in FORCED.items()) + f") FROM ({rows})"
    return rows


NEVER, NOTHING = "{'cost': 1000000, 'audit': ''}", "{'cost': 0, 'audit': ''}"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.replace("{0}", "key")} % 20 AS code
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations) k),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS times, trim(text, {BLANKS}) AS whole FROM damaged),
faulty AS (
  SELECT *, CASE WHEN whole = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN right(whole, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) || substr(role, 1, 1) AS meeting FROM placed),
letters AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE substr(role, 1, 1) END AS letter, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE meeting NOT IN ('su', 'ua', 'au')) AS illegal FROM letters GROUP BY conv_id),
solved AS (
  {_inserted(f"SELECT conv_id, n AS place, {NOTHING} AS start, {NEVER} AS system, {NEVER} AS us, {NOTHING} AS whole FROM counted")}
  UNION ALL
  {_inserted(f"SELECT n.conv_id, n.place - 1 AS place, {_cheapest()} FROM solved n JOIN letters l ON l.conv_id IS NOT DISTINCT FROM n.conv_id AND l.place = n.place")}),
audited AS (SELECT conv_id, start.cost AS cost, start.audit AS audit FROM solved WHERE place = 0),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS step FROM audited WHERE audit <> ''),
met AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY step) AS nth FROM edits),
stays AS (
  SELECT m.conv_id, m.step, edit, CASE WHEN edit = 'I' THEN '' ELSE l.text END AS text, CASE WHEN edit = 'K' THEN l.role END AS role, edit = 'K' AND l.letter = 's' AS system
  FROM met m LEFT JOIN letters l ON l.conv_id IS NOT DISTINCT FROM m.conv_id AND l.place = m.nth WHERE edit <> 'D'),
numbered AS (SELECT *, row_number() OVER w - count(*) FILTER (WHERE system) OVER w AS turned FROM stays WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
hashed AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN turned % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY step)) AS repaired_sha256 FROM numbered GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN audited a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM i.conv_id"""


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2048)
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "centroids")))


def _rounds() -> str:
    """The rounds of the clustering, each a pair of tables: what is nearest, and the centroids after it."""
    out = []
    for i in range(11):
        far = "list_sum(list_transform(range(1, 65), lambda j: (k.q[j] - c.q[j]) * (k.q[j] - c.q[j])))"
        out.append(f"near{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place FROM (SELECT k.rid, k.vec_id, k.q, c.cluster, {far} AS distance FROM kept k CROSS JOIN centres{i} c) d) p WHERE place = 1)")
        mean = "(s - (((s % n) + n) % n)) // n"
        out.append(f"""centres{i + 1} AS MATERIALIZED (SELECT cluster, list({mean} ORDER BY j) AS q FROM (SELECT cluster, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM near{i} CROSS JOIN range(1, 65) r(j) GROUP BY cluster, j) m GROUP BY cluster
 UNION ALL SELECT cluster, q FROM centres{i} WHERE cluster NOT IN (SELECT cluster FROM near{i}))""")
    return ",\n".join(out[:-1])


ORACLES["op12_centroid_clustering"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centres0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, embedding) - 1 AS INT) AS cluster, q FROM kept QUALIFY cluster < 8),
{_rounds()}
SELECT vec_id, n.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near10 n JOIN centres10 c ON c.cluster = n.cluster"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def _places(phrase: str) -> str:
    words = phrase.split()
    return "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words)) + ")"


_BASE = {label: _places(phrase) for phrase, label in licenses.PHRASES.items()}
_OWN = ", ".join(f"CASE WHEN regexp_matches(line, '{licenses.as_regex(markup)}') THEN '{label}' END" for label, markup in licenses.TEMPLATES)
ORACLES["op13_license_scan"] = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line, {", ".join(f"{places} AS {label}_places" for label, places in _BASE.items())} FROM words),
labelled AS (
  SELECT *, list_concat({", ".join(f"{label}_places" for label in _BASE)}) AS places, list_filter([{", ".join(f"CASE WHEN len({label}_places) > 0 THEN '{label}' END" for label in _BASE)}], lambda x: x IS NOT NULL) AS base,
         list_filter([{_OWN}], lambda x: x IS NOT NULL) AS own FROM found)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels, CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5 ELSE 0 END AS score
FROM labelled"""
