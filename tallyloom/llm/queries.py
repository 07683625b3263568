"""The queries of this subpackage, one for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, conversation_repair, digests, language, line_dedup, mixing, simhash, token_counts, token_files, vector_codes, vector_dedup, warc
from tallyloom.llm.common import scratch_path
from tallyloom.sources.small import dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; imported here, as only these queries need the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_edits(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(documents).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


OP4_SQL = r"""
WITH pages AS (SELECT source, text FROM documents),
lines AS (SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0))) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) >= 5),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY ALL),
lists AS (SELECT c.source, list(line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n > 0.02 * pages GROUP BY ALL),
met AS (
  SELECT doc_id, string_split(d.text, chr(10)) AS own, list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), x)) AS stay
  FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, array_to_string(stay, chr(10)) AS text, CAST(coalesce(len(own), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(own) - len(stay), 0) AS BIGINT) AS n_dropped FROM met
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages, none = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"), F.lit(None).cast("long")
    model = language.fit(documents)
    texts = language.from_documents(documents, F.col("doc_id"), none.alias("page_id"))
    return language.identify(texts.unionByName(language.from_pages(pages, none.alias("doc_id"), F.col("page_id"))), model)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mark = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), mark.alias("text"))
    return chat.digest(chat.format_turns(turns.unionByName(extra)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS turn_no, sum(15 + length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn_no)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn_no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(stop) FILTER (role = 'assistant'), 0) + CASE WHEN max(stop) > coalesce(max(stop) FILTER (role = 'assistant'), 0) THEN max(stop) ELSE 0 END AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM per
), leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT *, coalesce(least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), cap) AS target FROM leveled
), placed AS (
  SELECT s.*, g.source_size, g.target, row_number() OVER (PARTITION BY s.source ORDER BY
      CASE WHEN size > 0 THEN CAST(floor(log2(size) * 4) AS INT) ELSE -1 END, substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 2), size, doc_id ASC NULLS LAST) AS place,
    coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS each,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(s.source, '~')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(floor(start + each * place) - floor(start + each * (place - 1)) AS BIGINT) * size AS taken FROM placed
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return token_files.token_offsets(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), PATTERN)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), PATTERN)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damage(turns), every=turns)


def _op11_step() -> str:
    """The costs and edits from each of four states (nothing, system, user, assistant) on, one row before those in ``acc``."""
    follows, states = {1: "u", 2: "u", 3: "a", 4: "u"}, {1: 3, 2: 3, 3: 4, 4: 3}
    after = []
    for state in states:
        options, now = [], state
        for inserted in range(3):
            cost, run, then = 5 * inserted, "I" * inserted, states[now]
            one = lambda paid, edit, to: f"{{'c': acc[{to}].c + {paid}, 'r': '{edit}' || acc[{to}].r}}"
            late = "CASE WHEN upper(x) = x THEN 5 ELSE 0 END"
            options.append(one(cost + 2, run + "D", now))
            options.append(f"CASE WHEN x <> 'x' THEN {one(f'{cost + 1} + {late}', run + 'R', then)} END")
            options.append(f"CASE WHEN lower(x) = '{follows[now]}' THEN {one(f'{cost} + {late}', run + 'K', then)} END")
            if now == 1:
                options.append(f"CASE WHEN lower(x) = 's' THEN {one(f'{cost} + {late}', run + 'K', 2)} END")
            now = then
        after.append(f"list_min([{', '.join(options)}])")
    return f"[{', '.join(after)}]"


OP11_SQL = (
    r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key
  FROM conversations
), drawn AS (
  SELECT lots.*, xor(list_reduce(key, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS lot FROM lots, crc
), damaged AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE lot WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE lot <> 0
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(turn) OVER w AS last_turn, lag(role) OVER w AS last_role FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS whole FROM placed
), faults AS MATERIALIZED (
  SELECT *, CASE WHEN whole = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(whole, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial
  FROM seen
), signed AS (
  SELECT conv_id, list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END ORDER BY place) AS letters,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND last_role[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), solved AS (
  SELECT letters, list_reduce(list_reverse(letters), lambda acc, x: """
    + _op11_step()
    + r""",
    [{'c': CAST(0 AS BIGINT), 'r': ''}, {'c': CAST(10 AS BIGINT), 'r': 'II'}, {'c': CAST(5 AS BIGINT), 'r': 'I'}, {'c': CAST(0 AS BIGINT), 'r': ''}])[1] AS best
  FROM (SELECT DISTINCT letters FROM signed)
), audited AS MATERIALIZED (
  SELECT signed.*, best.c AS cost, best.r AS audit FROM signed JOIN solved USING (letters)
), edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS k FROM audited WHERE audit <> ''
), counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS nth FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), met AS (
  SELECT c.conv_id, k, c.nth, edit, role, text FROM counted c LEFT JOIN faults f ON edit <> 'I' AND c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.place = f.place WHERE edit <> 'D'
), led AS (
  SELECT *, CASE WHEN first_value(CASE WHEN edit = 'K' THEN role[1] END) OVER (PARTITION BY conv_id ORDER BY k) = 's' THEN 1 ELSE 0 END AS system FROM met
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM led GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN audited a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""
)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12_rounds(rounds: int) -> str:
    """Rounds of Lloyd over the distinct parts, and the last assignment as ``near{rounds}``. Products of integers below 2^53 are exact."""
    near = """near{k} AS MATERIALIZED (
  SELECT did, min(CAST(list_inner_product(d.part, d.part) - 2 * list_inner_product(d.part, b.part) + list_inner_product(b.part, b.part) AS BIGINT) * 256 + e) AS best
  FROM pieces d JOIN book{k} b USING (p) GROUP BY did
)"""
    moved = """sums{k} AS (
  SELECT p, best % 256 AS e, j, CAST(floor(sum(weight * x) / sum(weight)) AS BIGINT) AS x
  FROM (SELECT p, best, weight, unnest(range(len(part))) AS j, CAST(unnest(part) AS BIGINT) AS x FROM pieces JOIN near{k} USING (did)) GROUP BY p, best % 256, j
), book{next} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.part, b.part) AS part FROM book{k} b LEFT JOIN (SELECT p, e, list(CAST(x AS DOUBLE) ORDER BY j) AS part FROM sums{k} GROUP BY p, e) s ON b.p = s.p AND b.e = s.e
)"""
    return ",\n".join([x for k in range(rounds) for x in (near.format(k=k), moved.format(k=k, next=k + 1))] + [near.format(k=rounds)])


OP12_SQL = (
    r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS place, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT place, vec_id, label, p, list_slice(v, CAST(p * len(v) // 4 + 1 AS BIGINT), CAST((p + 1) * len(v) // 4 AS BIGINT)) AS part FROM kept, (SELECT unnest(range(4)) AS p)
), pieces AS MATERIALIZED (
  SELECT p, part, count(*) AS weight, row_number() OVER () AS did FROM parts GROUP BY p, part
), book0 AS (
  SELECT p, place - 1 AS e, part FROM parts WHERE place <= 256
), """
    + _op12_rounds(4)
    + r""", coded AS (
  SELECT vec_id, label, place, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM parts JOIN pieces USING (p, part) JOIN near4 USING (did) GROUP BY vec_id, label, place
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(part, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM coded
"""
)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.page_captures(spark, path)


OP13_SQL = r"""
WITH kept AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT payload, min(page_id) AS first FROM kept GROUP BY payload
)
SELECT page_id, CAST(strlen(k.payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM kept k JOIN firsts f ON k.payload = f.payload
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_digests": op1_digests,
    "op2_token_counts": op2_token_counts,
    "op3_vectors": op3_vectors,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_chat": op6_chat,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_repair": op11_repair,
    "op12_codes": op12_codes,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op6_chat": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op11_repair": OP11_SQL,
    "op12_codes": OP12_SQL,
    "op13_warc": OP13_SQL,
}
