"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, conversations, fim, language, mixing, near, neighbours, packing, pages, pii, quality, rules, toxicity
from .common import held_out, ready_checkpoints, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.KINDS], F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("found")).alias("spans"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn(docs, table(spark, sf_dir, "labels"))
    return rules.apply(docs, learned).select("doc_id", *rules.BASE, "base_failed", "kept")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.cluster(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    return language.predict(rows, language.learn(docs), ["doc_id", "held_out"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model, ["doc_id", "held_out"]).drop("passages")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    return quality.score(rows, quality.learn(docs, table(spark, sf_dir, "labels")), ["doc_id", "held_out"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.arrange(table(spark, sf_dir, "documents"))
    sha = [F.sha2(x, 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (fim.restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *sha)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.Repair(rows, F.col("copies")).digests()


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4()}"
    archives.archived(table(spark, sf_dir, "pages"), folder)
    return archives.read_pages(spark, folder)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii, op2_rules, op3_main_text, op4_near, op5_language, op6_mixing, op7_toxicity, op8_neighbours, op9_quality, op10_packing, op11_fim, op12_repair, op13_archives)}


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap FROM src),
runs AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS ws
         FROM w WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, min(CASE WHEN cap * ws <= rest * w THEN 1 ELSE 0 END) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM runs),
t AS (SELECT source, source_size, CASE WHEN capped = 1 THEN cap ELSE max(CASE WHEN capped = 0 THEN rest END) OVER () * w / max(CASE WHEN capped = 0 THEN ws END) OVER () END AS target FROM flagged),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
cum AS (SELECT s.doc_id, s.size, s.source, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto FROM sized s)
SELECT c.doc_id, c.size::BIGINT AS size, p.source_size, p.target,
       (c.size * (p.passes + CASE WHEN c.upto <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum c JOIN p ON c.source IS NOT DISTINCT FROM p.source
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
                            lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM named),
rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS solid, left(role, 1) AS initial FROM rows_),
faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         CASE WHEN i > 1 AND lag(initial) OVER w || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
-- the least costs to go from start, system, user and assistant behind row i, with the way there
togo AS (
  SELECT conv_id, n AS i, 0::BIGINT AS g0, 6::BIGINT AS gs, 3::BIGINT AS gu, 0::BIGINT AS ga FROM faulty WHERE i = 1
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + bu, 6 + ba), least(bs, 3 + bu, 6 + ba), least(bu, 3 + ba), least(ba, 3 + bu) FROM (
    SELECT g.conv_id, g.i - 1 AS i,
      least(4 + g.g0, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE t + least(3 + g.gu, CASE f.initial WHEN 's' THEN g.gs WHEN 'u' THEN g.gu ELSE 1000000000 END) END) AS b0,
      least(4 + g.gs, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE t + least(3 + g.gu, CASE f.initial WHEN 'u' THEN g.gu ELSE 1000000000 END) END) AS bs,
      least(4 + g.gu, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE t + least(3 + g.ga, CASE f.initial WHEN 'a' THEN g.ga ELSE 1000000000 END) END) AS bu,
      least(4 + g.ga, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE t + least(3 + g.gu, CASE f.initial WHEN 'u' THEN g.gu ELSE 1000000000 END) END) AS ba
    FROM togo g JOIN (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS t FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i)),
costs AS (SELECT conv_id, i, unnest(['0', 's', 'u', 'a']) AS state, unnest([g0, gs, gu, ga]) AS c FROM togo),
-- forward: at each step the edit that is least in ASCII among those on a cheapest way
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, '' AS audit, '' AS out, 0 AS written, false AS done FROM faulty WHERE i = 1
  UNION ALL
  SELECT conv_id, ni, ns, audit || edit, CASE WHEN line IS NULL THEN out WHEN written = 0 THEN line ELSE out || chr(10) || line END, written + CASE WHEN line IS NULL THEN 0 ELSE 1 END, edit = '' FROM (
    SELECT w.*, o.edit, o.ni, o.ns, o.line, row_number() OVER (PARTITION BY w.conv_id ORDER BY o.edit) AS r
    FROM walk w JOIN costs here ON here.conv_id IS NOT DISTINCT FROM w.conv_id AND here.i = w.i AND here.state = w.state
    LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    CROSS JOIN (SELECT unnest(['', 'D', 'I', 'K', 'R']) AS e) x
    CROSS JOIN LATERAL (
      SELECT x.e AS edit, w.i + CASE WHEN x.e IN ('D', 'K', 'R') THEN 1 ELSE 0 END AS ni,
             CASE WHEN x.e IN ('I', 'R') THEN CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END WHEN x.e = 'K' THEN f.initial ELSE w.state END AS ns,
             CASE x.e WHEN 'I' THEN CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END WHEN 'K' THEN f.role || ':' || f.text WHEN 'R' THEN CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text END AS line,
             CASE x.e WHEN '' THEN 0 WHEN 'I' THEN 3 WHEN 'D' THEN 4 ELSE CASE x.e WHEN 'R' THEN 3 ELSE 0 END + CASE f.fault WHEN 't' THEN 3 ELSE 0 END END AS price) o
    LEFT JOIN costs there ON there.conv_id IS NOT DISTINCT FROM w.conv_id AND there.i = o.ni AND there.state = o.ns
    WHERE NOT w.done AND CASE
        WHEN x.e = '' THEN f.i IS NULL AND w.state IN ('0', 'a')
        WHEN x.e = 'I' THEN here.c = 3 + there.c
        WHEN f.i IS NULL THEN false
        WHEN x.e = 'D' THEN here.c = 4 + there.c
        WHEN f.fault IN ('b', 'd') THEN false
        WHEN x.e = 'K' THEN (f.initial = 's' AND w.state = '0' OR f.initial = 'u' AND w.state <> 'u' OR f.initial = 'a' AND w.state = 'u') AND here.c = o.price + there.c
        ELSE here.c = o.price + there.c END)
  WHERE r = 1),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, sum(bad)::BIGINT AS illegal
  FROM faulty GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(g.g0, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(w.out, '')) AS repaired_sha256
FROM ids LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN togo g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id AND g.i = 0
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id AND w.done
"""

OP13_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op11_fim": OP11_SQL, "op12_repair": OP12_SQL, "op13_archives": OP13_SQL}
