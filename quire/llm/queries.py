"""The registered queries of the numbered operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    chat_format,
    collocations,
    decontaminate,
    html_extract,
    lm_backoff,
    packing,
    quality_cnn,
    quality_rules,
    simhash,
    substring_dedup,
    token_alignment,
    toxicity,
    url_filter,
)
from quire.llm.common import crc32_of_id, table

#: The added conversation: its two turns say the same, in the template's own kind of marks.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"
#: (host, path, action)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
                                  rows.schema)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    records = rows.unionByName(probe).select("conv_id", "turn", record.alias("record"))
    return chat_format.read_back(chat_format.format_chat(records))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 4 == 2
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (toxicity.scored(docs, machine)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 3 == 1
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (quality_cnn.scored(docs, net)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op7_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.score(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        digest.alias("groups_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), spread_by=("doc_id",))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_lm_backoff": op7_lm_backoff,
    "op8_html_extract": op8_html_extract,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    # a turn is written as <turn ROLE>, TEXT and </turn> on lines of their own, and a backslash stands before \ and < of
    # the text, and before \, <, > and line feeds of the role
    "op1_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, n, r, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ') + 2 * length(role) - length(translate(role, '\\<>' || chr(10), '')) + length('>' || chr(10))
    + 2 * length(text) - length(translate(text, '\\<', '')) + length(chr(10) || '</turn>' || chr(10))) AS BIGINT)
    AS formatted_chars
FROM t GROUP BY conv_id""",
    "op11_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
  k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j
           FROM (SELECT k.doc_id, k.i FROM k JOIN (SELECT h, min(doc_id) AS least FROM k GROUP BY h) m ON m.h = k.h
                 WHERE m.least < k.doc_id)),
  words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
  kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS text FROM words
           ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op13_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
  split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  place AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split)),
  total AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
  f1 AS (SELECT lang, a, count(*) AS f FROM place GROUP BY ALL),
  f2 AS (SELECT lang, a, b, count(*) AS f FROM place WHERE b IS NOT NULL GROUP BY ALL),
  f3 AS (SELECT lang, a, b, c, count(*) AS f FROM place WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
  cuts AS (SELECT p.lang, p.a || ' ' || p.b AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
           FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.a = p.a JOIN f1 y ON y.lang = p.lang AND y.a = p.b
           WHERE p.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 q WHERE q.lang = p.lang AND 100 * q.f >= 50 * p.f
             AND ((q.a = p.a AND q.b = p.b) OR (q.b = p.a AND q.c = p.b)))
           UNION ALL SELECT p.lang, p.a || ' ' || p.b || ' ' || p.c, p.f, 1, x.f, y.f
           FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.a = p.a JOIN f2 y ON y.lang = p.lang AND y.a = p.b AND y.b = p.c
           UNION ALL SELECT p.lang, p.a || ' ' || p.b || ' ' || p.c, p.f, 2, x.f, y.f
           FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.a = p.a AND x.b = p.b JOIN f1 y ON y.lang = p.lang AND y.a = p.c),
  scored AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT * FROM (SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
                 a, l, r, n, score FROM best JOIN total ON total.lang = best.lang) WHERE rank <= 2000""",
}
