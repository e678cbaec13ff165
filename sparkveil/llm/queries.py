"""The registered queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import bpe, deobfuscate, hpylm, merkle, mixing, neardup, rules, telephony, toxicity, urlrules
from sparkveil.llm._common import table

#: The vocabulary that op10 and the pipeline use, by its name among the public tokenizers.
TOKENIZER = "byte_bpe_50k.tiktoken"

#: The rules that op3 applies.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def rank_file(name: str = TOKENIZER) -> tuple[bytes, str]:
    """The bytes of a public tokenizer's rank file (about 1 MB) and its pattern, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = telephony.decode_media(telephony.encode_media(docs, keep=["doc_id"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("bigint").alias("pcm_bytes"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), rules(action, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), judged AS (
  SELECT s.page_id, s.host, s.path,
         (SELECT max_by(struct_pack(rule := r.rule, action := r.action), length(r.rule)) FROM rules r
          WHERE (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)) AS best
  FROM split s
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""


#: What happens to a replica's records, by the first two digits of a hash of their page_id: a flipped letter case, a
#: lost record, a body cut in half, or a record that comes in beside it.
FLIPPED, LOST, CUT, DOUBLED = "00", "01", "02", "03"


def op4_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.language_model_scores(table(spark, sf_dir, "documents"))


def op5_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    primary = pages.select("page_id", merkle.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    what = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), F.lit(""))
    body = F.when(what == FLIPPED, F.concat(F.upper(F.substring("html", 1, 40)), F.expr("substring(html, 41)"))).when(what == CUT, F.expr("left(html, cast(length(html) / 2 AS int))")).otherwise(F.col("html"))
    ids = F.when(what == DOUBLED, F.array("page_id", -F.col("page_id"))).otherwise(F.array("page_id"))
    held = pages.where(what != LOST).select(F.explode(ids).alias("page_id"), "url", body.alias("html"))
    replica = held.select("page_id", merkle.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return merkle.audit(primary, replica)


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"

OP5_SQL = rf"""
WITH marked AS (
  SELECT page_id, url, html, substring(md5(page_id::VARCHAR), 1, 2) AS what FROM pages
), damaged AS (
  SELECT page_id, url, what, CASE what WHEN '00' THEN upper(substring(html, 1, 40)) || substring(html, 41) WHEN '02' THEN substring(html, 1, length(html) // 2) ELSE html END AS html
  FROM marked WHERE what <> '01'
), sides AS (
  SELECT 0 AS side, page_id, {_RECORD} AS record FROM marked
  UNION ALL SELECT 1, page_id, {_RECORD} FROM damaged
  UNION ALL SELECT 1, page_id, {_RECORD} FROM (SELECT -page_id AS page_id, url, html FROM damaged WHERE what = '03')
), entries AS (
  SELECT side, page_id, sha256(record) AS digest, strlen(record) AS length,
         ('0x' || substring(md5(page_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 256.0))::BIGINT FROM pages) AS file_id
  FROM sides
), placed AS (
  SELECT *, row_number() OVER files - 1 AS seq, coalesce(sum(length) OVER (files ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM entries WINDOW files AS (PARTITION BY side, file_id ORDER BY page_id, digest)
)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file_id, b.file_id) AS file_id, a.seq, a.at::BIGINT AS "offset", coalesce(a.length, b.length)::BIGINT AS length, a.digest,
       b.seq AS replica_seq, b.at::BIGINT AS replica_offset, b.digest AS replica_digest,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'altered' WHEN a.seq = b.seq AND a.at = b.at THEN 'intact' ELSE 'moved' END AS status
FROM (SELECT * FROM placed WHERE side = 0) a FULL JOIN (SELECT * FROM placed WHERE side = 1) b ON a.page_id = b.page_id
"""


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("some", F.explode(mixing.each(F.col("rows")))).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("some"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies")


def op7_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deobfuscate.deobfuscate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in deobfuscate.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(rules.BASE.mask)) != 0).alias("base_failed"), "kept", "failed", "policy_version")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), measured AS (
  SELECT doc_id, len(w) AS n_words, len(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_aggregate(list_concat(regexp_extract_all(body, '\p{L}'), ['']), 'string_agg', '') AS letters, w
  FROM words
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM measured WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows) WHERE c >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), facts AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, length(letters) AS n_letters
  FROM measured m LEFT JOIN covered c ON m.doc_id = c.doc_id
), bits AS (
  SELECT *, (n_words < 50)::BIGINT * 1 + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2
         + (10 * n_symbols > 6 * n_words AND n_words >= 50)::BIGINT * 4
         + (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::BIGINT * 8
         + (word_chars > 40 * n_words)::BIGINT * 16 + (2 * word_chars < 3 * n_words)::BIGINT * 32
         + (100 * n_letters < 40 * word_chars)::BIGINT * 64 AS failed
  FROM facts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed, 3 AS policy_version
FROM bits
"""


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule rejects, and what only it rejects, from operator 8's ledger."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


ABLATIONS_SQL = f"""
WITH ledger AS ({OP8_SQL}), rules(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << i})" for i, name in enumerate(rules.RULES))})
SELECT rule, (SELECT count(*) FROM ledger WHERE failed & bit <> 0) AS failing, (SELECT count(*) FROM ledger WHERE failed = bit) AS only_this, (SELECT count(*) FROM ledger WHERE failed <> 0) AS rejected FROM rules
"""


def op9_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0  # a null id counts as no text
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "lexicon_weight")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = rank_file()
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, keep=["doc_id"], as_bytes=True)
    read = bpe.decode(coded, ranks, pattern)
    return read.select("doc_id", (F.length("token_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_odd_sketch, op2_telephony_audio, op3_url_rules, op4_hierarchical_pitman_yor, op5_warc_merkle_audit, op6_pivotal_mixing, op7_deobfuscated_pii, op8_quality_rules, op9_toxicity_lexicon, op10_byte_bpe, rule_ablations)}
ORACLES: dict[str, str] = {"op3_url_rules": OP3_SQL, "op5_warc_merkle_audit": OP5_SQL, "op8_quality_rules": OP8_SQL, "rule_ablations": ABLATIONS_SQL}
