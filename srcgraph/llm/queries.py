"""The registered queries of this subpackage, one per numbered operator, and their DuckDB SQL."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, ngram_lm, sp_codec
from .common import fold
from .conversation_repair import damaged, repair
from .exact_dedup import exact_dedup
from .langid import identify
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .periodic_runs import periodic_runs, planted_runs, strongest
from .quality_rules import quality_rules
from .token_counts import count_tokens
from .warc_audit import audit_replicas, warc_records


COUNTED_TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
TOKENIZER = os.environ.get("SP_MODEL_FILE", "/opt/tokenizers/piece_bpe_32k.model")
MIX_WEIGHTS = {"domain": {"d0": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens: domains alike except d0 with twice the weight, languages by MIX_WEIGHTS, sources alike."""
    m = mix(_documents(spark, sf_dir), budget_share=0.5, max_epochs=4, seed=1, weights=MIX_WEIGHTS)
    return m.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"),
                    F.col("mix_times").cast("long").alias("times"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(_documents(spark, sf_dir))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return identify(_documents(spark, sf_dir), fold("doc_id", 3) != 1, [F.col("doc_id"), held])


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = ngram_lm.train(docs.where(fold("doc_id", 10) != 0), min_counts=(1, 1))  # no n-gram is pruned
    return ngram_lm.score(docs, model, [F.col("doc_id"), F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out")])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sp_codec.encode(_documents(spark, sf_dir), TOKENIZER, [F.col("doc_id")])
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.hex(F.xxhash64("ids")).alias("ids_hash"),
                    "parity", "round_trip")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model, [F.col("doc_id")])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return d.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(_documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
                    "base_failed", "kept")


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the archive of all pages (one archive per file of the table, in row order) in which
    the last byte of the body was lost to another in each record whose url's MD5 begins with 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a = warc_records(pages, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.col("_metadata.row_index"),
                     keep=(F.coalesce("url", F.lit("")).alias("url"),))
    n = F.octet_length("record")
    damaged = F.concat(F.substring("record", F.lit(1), n - 5), F.lit("#").cast("binary"),
                       F.substring("record", n - 3, F.lit(4)))
    b = a.withColumn("record", F.when(F.md5(F.col("url").cast("binary")).startswith("0"), damaged).otherwise(F.col("record")))
    return audit_replicas(a, b)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    n = count_tokens(_documents(spark, sf_dir), public_tokenizers.path(COUNTED_TOKENIZER), [F.col("doc_id")])
    return n.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(c), c.select("conv_id"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    r = periodic_runs(docs.select("doc_id", planted_runs("text", "doc_id").alias("text")), [F.col("doc_id")])
    r = r.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_near_dedup": op5_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc_audit": op10_warc_audit,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_SP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINES = f"""l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
         k AS (SELECT *, {_KEY} AS key FROM l)"""
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _mix_share(level: str, parents: str, given: str, weight: str) -> str:
    """SQL that fills the children of one level; ``given`` is a table of (parents, given)."""
    part = f"PARTITION BY {parents}" if parents else ""
    using = f"JOIN {given} USING ({parents})" if parents else f", {given}"
    cols = f"{parents}, {level}" if parents else level
    return f"""
{level}_c AS (SELECT {cols}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY {cols}),
{level}_w AS (SELECT *, ({weight})::DOUBLE AS w FROM {level}_c {using}),
{level}_l AS (SELECT *, given - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_b,
              sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS all_w FROM {level}_w),
{level}_f AS (SELECT *, cap * all_w <= rest_b * w AS is_full FROM {level}_l),
{level}_r AS (SELECT *, max(CASE WHEN NOT is_full THEN rest_b / all_w END) OVER ({part}) AS rate FROM {level}_f),
{level}_b AS (SELECT {cols}, CASE WHEN is_full THEN cap ELSE least(cap, floor(rate * w)::BIGINT) END AS given FROM {level}_r)"""


def _more(value: str, cost: str, letters: str) -> str:
    """SQL that puts letters before a repair's audit; a value is its cost in 12 digits, then its audit, so the least text is the best repair."""
    return f"printf('%012d', left({value}, 12)::BIGINT + {cost}) || '{letters}' || substr({value}, 13)"


def _repair_sql() -> str:
    """Damage, faults and a fold over each conversation from its last turn back: per symbol that came last the best repair of the rest."""
    after = {"0": "u", "s": "u", "u": "a", "a": "u"}
    turn = []
    for x, y in after.items():
        ways = [_more(f"v{x}", "4", "D"),
                f"CASE WHEN forced THEN '~' WHEN initial = '{y}' THEN {_more(f'v{y}', 'late', 'K')} ELSE {_more(f'v{y}', '3 + late', 'R')} END"]
        if x == "0":
            ways.append(f"CASE WHEN forced OR initial <> 's' THEN '~' ELSE {_more('vs', 'late', 'K')} END")
        turn.append(f"least({', '.join(ways)}) AS b{x}")
    insert = {x: f"least(b{x}, {_more(f'b{y}', '3', 'I')}" + (f", {_more('ba', '6', 'II')})" if x in "0s" else ")") for x, y in after.items()}
    byte = "[ord(c), -1, -1, -1, -1, -1, -1, -1, -1]"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: {byte})),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT) % 20 AS k
     FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
t AS (SELECT *, left(role, 1) AS initial, trim(text, {_SP}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             right(trim(text, {_SP}), 1) NOT IN ('.', '!', '?') AS open_end FROM n),
r AS (SELECT *, blank OR again AS forced, CASE WHEN open_end THEN 3 ELSE 0 END AS late,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM t),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE open_end AND NOT blank AND NOT again) AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
f AS (SELECT conv_id, n + 1 AS i, '000000000000' AS v0, '000000000006II' AS vs, '000000000003I' AS vu, '000000000000' AS va FROM s
      UNION ALL
      SELECT conv_id, i, {insert['0']}, {insert['s']}, {insert['u']}, {insert['a']}
      FROM (SELECT f.conv_id, f.i - 1 AS i, {', '.join(turn)} FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1)),
b AS (SELECT conv_id, left(v0, 12)::BIGINT AS cost, substr(v0, 13) AS audit FROM f WHERE i = 1),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos, length(replace(audit, 'D', '')) AS len
      FROM b WHERE audit <> ''),
p AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS nth FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT p.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - len % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
             || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired
      FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE edit <> 'D' GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL: dict[str, str] = {
    "op1_source_mixing": f"""
WITH d AS (SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 4) AS domain, lang, source,
                  len({_WORDS.format("coalesce(text, '')")})::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 4 * sum(n_tokens)::BIGINT AS cap FROM d GROUP BY domain, lang, source),
root AS (SELECT floor(sum(tokens) * 0.5)::BIGINT AS given FROM leaves),
{_mix_share("domain", "", "root", "CASE domain WHEN 'd0' THEN 2 ELSE 1 END")},
{_mix_share("lang", "domain", "domain_b", "CASE lang WHEN 'en' THEN 4 ELSE 2 END")},
{_mix_share("source", "domain, lang", "lang_b", "1")},
plan AS (SELECT domain, lang, source, tokens, given // tokens AS epochs, given - tokens * (given // tokens) AS rest
         FROM leaves JOIN source_b USING (domain, lang, source)),
k AS (SELECT *, md5('1|' || (epochs + 1) || '|' || doc_id) AS key FROM d JOIN plan USING (domain, lang, source)),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM k)
SELECT doc_id, domain, lang, source, n_tokens, epochs + (begins < rest)::BIGINT AS times FROM b WHERE epochs + (begins < rest)::BIGINT > 0""",
    "op2_line_dedup": f"""
WITH {_LINES},
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i+4], ' ')))
                                          WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_quality_rules": f"""
WITH {_LINES},
w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
win2 AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+7], ' ')) AS x FROM win),
rep AS (SELECT doc_id, x FROM win2 GROUP BY doc_id, x HAVING count(*) > 1),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win2 JOIN rep USING (doc_id, x)),
rw AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE key <> '' GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
f AS (SELECT source, key FROM k JOIN hosts USING (source) WHERE key <> '' GROUP BY source, key, hosts.n
      HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > hosts.n * 0.01::DOUBLE),
gone AS (SELECT doc_id, sum(len({_WORDS.format("key")})) AS n FROM k JOIN f USING (source, key) GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id)),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words <= n_words * 0.5 AS kept FROM c""",
    "op10_warc_audit": r"""
WITH p AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT pos, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
             || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head, html,
             chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM p),
n AS (SELECT *, (strlen(head) + strlen(html) + 4)::BIGINT AS len FROM r),
o AS (SELECT *, coalesce(sum(len) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM n)
SELECT 'pages.parquet' AS archive, pos, "offset", len AS len_a, len AS len_b, sha256(head || html || tail) AS hash_a,
       sha256(head || left(html, length(html) - 1) || '#' || tail) AS hash_b, 'changed' AS status
FROM o WHERE md5(url) LIKE '0%'""",
    "op12_conversation_repair": _repair_sql(),
}
