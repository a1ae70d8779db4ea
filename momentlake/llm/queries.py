"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm import ann, bpe, chat, decontaminate, hmm, line_dedup, near_dedup, packing, repair, spelling, suffix_dedup, toxicity, warc
from momentlake.llm._shared import crc_mod, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return warc.read_warc(spark, path, with_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")
    )


_SAMPLE_TURN = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(_SAMPLE_TURN).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(turns.unionByName(extra)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return toxicity.score_toxicity(docs, labels, held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    leaks = decontaminate.find_leaks(docs, benchmark)
    return leaks.select(
        "doc_id",
        F.size("leaks").cast("long").alias("n_windows"),
        F.size(F.array_distinct("leaks.item_id")).cast("long").alias("n_items"),
        F.array_min("leaks.item_id").alias("first_item"),
        (F.size("leaks") > 0).alias("contaminated"),
    )


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod(F.col("doc_id"), 10) == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), change=spelling.drop_one_of(199))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit(" ")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    h = F.crc32(key.cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(h == 4, "user").otherwise(F.col("role"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    damaged = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")
    fixed = repair.repair(damaged).withColumnRenamed("conv_id", "own")
    every = turns.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ann": op4_ann,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_hmm_score": op10_hmm_score,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_bpe": op13_bpe,
}

_CRC = """crcs AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(octets: str) -> str:
    """crc32 of a list of bytes, with crcs in the FROM clause."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT p.*, array_to_string(list_transform(range(1, 41), lambda i: substr(
        '0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) * 4 + 1, 4)), '') AS bits FROM p),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
        array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
          + 16 * substr(bits, 5 * j + 1, 1)::INT + 8 * substr(bits, 5 * j + 2, 1)::INT + 4 * substr(bits, 5 * j + 3, 1)::INT
          + 2 * substr(bits, 5 * j + 4, 1)::INT + substr(bits, 5 * j + 5, 1)::INT, 1)), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op2_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS body,
        CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) + 6
             ELSE length(role) + length(regexp_replace(role, '[^\\#<]', '', 'g')) + 11 END AS head FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head + body + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op8_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p+1] || chr(10) || ls[p+2] AS t
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM w
      WHERE length(replace(replace(t, chr(10), ''), ' ', '')) > 0),
c AS (SELECT DISTINCT doc_id, p + d AS i FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS d FROM r WHERE k > 1)),
e AS (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS kept, count(*) AS n
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i WHERE c.i IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE md5(coalesce(k.kept, '')) END AS kept_md5
FROM l LEFT JOIN k ON l.doc_id = k.doc_id""",
    "op11_spelling": f"""
WITH RECURSIVE {_CRC},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY doc, run),
h AS (SELECT run, c, {_crc("flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))")} AS h FROM g, crcs),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT v.word, d.word, d.n FROM v JOIN d ON d.rest = v.word UNION SELECT d.word, v.word, v.n FROM v JOIN d ON d.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END::BIGINT AS form_n FROM v LEFT JOIN b ON b.word = v.word),
t AS (SELECT word, word AS at, form AS further FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.further)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.further IS NULL""",
    "op12_repair": f"""
WITH RECURSIVE {_CRC},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          {_crc("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x))")} % 20 AS h FROM conversations, crcs),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
w AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS trimmed, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, CASE WHEN trimmed = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM w),
e AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more, role || ':' || text AS line FROM f),
k AS (SELECT conv_id, n AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS p, {{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s, {{'c': 5, 'a': 'I', 'r': ['assistant:']}} AS u, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS a
        FROM e WHERE i = 1
      UNION ALL
      SELECT conv_id, i, list_min([p, {{'c': u.c + 5, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}}, {{'c': a.c + 10, 'a': 'II' || a.a, 'r': list_concat(['user:', 'assistant:'], a.r)}}]),
        list_min([s, {{'c': u.c + 5, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}}, {{'c': a.c + 10, 'a': 'II' || a.a, 'r': list_concat(['user:', 'assistant:'], a.r)}}]),
        list_min([u, {{'c': a.c + 5, 'a': 'I' || a.a, 'r': list_prepend('assistant:', a.r)}}]),
        list_min([a, {{'c': u.c + 5, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}}])
      FROM (SELECT k.conv_id, k.i - 1 AS i,
        list_min([{{'c': p.c + 2, 'a': 'D' || p.a, 'r': p.r}}, {{'c': u.c + 1 + more + CASE WHEN gone THEN 999 ELSE 0 END, 'a': 'R' || u.a, 'r': list_prepend('user:' || text, u.r)}},
          {{'c': u.c + more + CASE WHEN gone OR x <> 'u' THEN 999 ELSE 0 END, 'a': 'K' || u.a, 'r': list_prepend(line, u.r)}}, {{'c': s.c + more + CASE WHEN gone OR x <> 's' THEN 999 ELSE 0 END, 'a': 'K' || s.a, 'r': list_prepend(line, s.r)}}]) AS p,
        list_min([{{'c': s.c + 2, 'a': 'D' || s.a, 'r': s.r}}, {{'c': u.c + 1 + more + CASE WHEN gone THEN 999 ELSE 0 END, 'a': 'R' || u.a, 'r': list_prepend('user:' || text, u.r)}},
          {{'c': u.c + more + CASE WHEN gone OR x <> 'u' THEN 999 ELSE 0 END, 'a': 'K' || u.a, 'r': list_prepend(line, u.r)}}]) AS s,
        list_min([{{'c': u.c + 2, 'a': 'D' || u.a, 'r': u.r}}, {{'c': a.c + 1 + more + CASE WHEN gone THEN 999 ELSE 0 END, 'a': 'R' || a.a, 'r': list_prepend('assistant:' || text, a.r)}},
          {{'c': a.c + more + CASE WHEN gone OR x <> 'a' THEN 999 ELSE 0 END, 'a': 'K' || a.a, 'r': list_prepend(line, a.r)}}]) AS u,
        list_min([{{'c': a.c + 2, 'a': 'D' || a.a, 'r': a.r}}, {{'c': u.c + 1 + more + CASE WHEN gone THEN 999 ELSE 0 END, 'a': 'R' || u.a, 'r': list_prepend('user:' || text, u.r)}},
          {{'c': u.c + more + CASE WHEN gone OR x <> 'u' THEN 999 ELSE 0 END, 'a': 'K' || u.a, 'r': list_prepend(line, u.r)}}]) AS a
        FROM k JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id AND e.i = k.i)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM e GROUP BY conv_id),
l AS (SELECT a.conv_id, count(*) FILTER (a.x || b.x NOT IN ('su', 'ua', 'au')) AS illegal FROM e a JOIN e b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1 GROUP BY a.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(k.p.c, 0)::BIGINT AS cost, coalesce(k.p.a, '') AS audit, sha256(coalesce(array_to_string(k.p.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.i = 0""",
}
