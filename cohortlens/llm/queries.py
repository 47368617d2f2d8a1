"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_compression_bands")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.compression_bands import compression_bands

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", compression_bands(F.col("text")).alias("q")).select("doc_id", "q.*")


@query("op5_credential_linking")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.credentials import credential_spans

    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", credential_spans(F.col("text")).alias("c"))
    return found.select("doc_id", "c.*").drop("found")


@query("op6_gzip_normaliser")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.warc import archive_pages, read_archives

    folder, index = archive_pages(spark, table(spark, sf_dir, "pages"))
    return read_archives(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: vocabulary file of op8, a name or path that the tokenizer package resolves; the id that ends a document
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_definition(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op8_rans_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.range_coder import read_documents, read_index, write_tokens

    folder = write_tokens(table(spark, sf_dir, "documents"), tokenizer_definition(), END_ID)
    return read_documents(read_index(spark, folder), folder)


JUMP_SHARDS = 40

SQL_OP3 = f"""
WITH RECURSIVE keyed AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
            THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crcs AS (
    SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM keyed, crc_table),
jumps AS (
    SELECT rid, -1::BIGINT AS b, 0::BIGINT AS j,
           (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k FROM keyed
    UNION ALL
    SELECT rid, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT, nk
    FROM (SELECT rid, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk
          FROM jumps WHERE j <= {JUMP_SHARDS}) s),
shards AS (
    SELECT rid, max(b) FILTER (b < {JUMP_SHARDS}) AS shard, max(b) AS grown_shard FROM jumps GROUP BY rid)
SELECT doc_id, (strlen(body) + 16)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), crc, strlen(body)) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM keyed JOIN crcs USING (rid) JOIN shards USING (rid)
"""


@query("op3_jump_hash", SQL_OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.jump_hash import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), JUMP_SHARDS)


@query("op9_fair_queueing", """
WITH sized AS (
    SELECT doc_id, coalesce(text, '') AS body, source,
           coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
rows AS (
    SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || body) AS key FROM sized),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS position, 3 * source_size AS cap,
           sum(source_size) OVER ()::BIGINT AS total FROM totals),
w AS (
    SELECT *, [5, 2, 1][(position - 1) % 3 + 1] AS weight FROM weighted),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY cap / weight, position) AS rank FROM w),
filled AS (
    SELECT *, (total - (sum(cap) OVER (ORDER BY rank) - cap))::DOUBLE
              / (sum(weight) OVER () - sum(weight) OVER (ORDER BY rank) + weight)::DOUBLE AS unit FROM ranked),
capping AS (
    SELECT *, bool_and(cap / weight <= unit) OVER (ORDER BY rank) AS capped FROM filled),
targets AS (
    SELECT source, source_size, position, total, CASE WHEN capped THEN cap::DOUBLE
        ELSE (min({'r': rank, 'u': unit}) FILTER (NOT capped) OVER ()).u * weight END AS target FROM capping),
queued AS (
    SELECT r.doc_id, r.size, r.key, t.source_size, t.target, t.total, t.position,
           sum(r.size) OVER (PARTITION BY t.position ORDER BY r.key ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
    SELECT *, (epoch * source_size + sent)::DOUBLE / target AS finish
    FROM queued, range(3) e(epoch)
    WHERE target > 0 AND (epoch * source_size + sent - size)::DOUBLE / target < 1),
sorted AS (
    SELECT *, sum(size) OVER (ORDER BY finish, position, key, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (
    SELECT doc_id, key, sum(size)::BIGINT AS taken FROM sorted WHERE upto <= total GROUP BY doc_id, key)
SELECT q.doc_id, any_value(q.source_size) AS source_size, any_value(q.size) AS size, any_value(q.target) AS target,
       coalesce(any_value(t.taken), 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.key = t.key
GROUP BY q.doc_id, q.key
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.fair_queue import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL_OP7 = r"""
WITH units AS (SELECT [UNITS] AS u),
all_texts AS (
    SELECT DISTINCT 'doc' AS side, doc_id AS id, coalesce(text, '') AS body FROM documents
    UNION ALL SELECT DISTINCT 'item', item_id, coalesce(text, '') FROM benchmark),
worded AS (
    SELECT side, id, body, list_filter(list_transform(regexp_extract_all(body, '[^\x20\x09-\x0D]+'),
        lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS words
    FROM all_texts),
typed AS (
    SELECT side, id, body, list_transform(words, lambda w: CASE
            WHEN w[1] BETWEEN '0' AND '9' THEN '<num>' WHEN list_contains(u, lower(w)) THEN '<unit>'
            WHEN lower(w[1]) <> w[1] THEN '<name>' ELSE lower(w) END) AS template,
        list_transform(words, lambda w: lower(w)) AS lowered
    FROM worded, units),
windows AS (
    SELECT side, id, body, place, array_to_string(template[place:place + 7], ' ') AS code,
           template[place:place + 7] AS tpl, lowered[place:place + 7] AS vals
    FROM (SELECT *, unnest(range(1, len(template) - 6)) AS place FROM typed)),
item_windows AS (
    SELECT * FROM windows WHERE side = 'item'
    AND len(list_filter(tpl, lambda t: t NOT IN ('<num>', '<unit>', '<name>'))) >= 4),
item_words AS (
    SELECT id, body, count(DISTINCT place + o) AS n_words FROM item_windows, range(8) r(o) GROUP BY id, body),
met AS (
    SELECT d.id AS doc, d.body AS doc_body, i.id AS item, i.body AS item_body, i.place, d.place - i.place AS shift,
           i.tpl, i.vals AS v, d.vals AS u
    FROM windows d JOIN item_windows i ON d.code = i.code WHERE d.side = 'doc'),
slots AS (
    SELECT DISTINCT doc, doc_body, item, item_body, shift, v[o + 1] AS v, u[o + 1] AS u
    FROM met, range(8) r(o) WHERE tpl[o + 1] IN ('<num>', '<unit>', '<name>')),
per_value AS (
    SELECT doc, doc_body, item, item_body, shift, v, count(*) AS n FROM slots GROUP BY ALL),
per_shift AS (
    SELECT doc, doc_body, item, item_body, shift, count(*) AS n_values, count(*) FILTER (n = 1) AS n_single
    FROM per_value GROUP BY ALL),
kept AS (
    SELECT DISTINCT m.doc, m.doc_body, m.item, m.item_body, m.shift, m.place FROM met m LEFT JOIN per_shift p
    ON m.doc IS NOT DISTINCT FROM p.doc AND m.doc_body = p.doc_body
        AND m.item IS NOT DISTINCT FROM p.item AND m.item_body = p.item_body AND m.shift = p.shift
    WHERE coalesce(p.n_single, 0) >= 0.8 * coalesce(p.n_values, 0)),
covered AS (
    SELECT doc, doc_body, item, item_body, count(DISTINCT place) AS n_windows, count(DISTINCT place + o) AS n
    FROM kept, range(8) r(o) GROUP BY ALL),
changed AS (
    SELECT doc, doc_body, item, item_body, count(*) AS n_slots, count(*) FILTER (v <> u) AS n_changed
    FROM (SELECT DISTINCT s.doc, s.doc_body, s.item, s.item_body, s.v, s.u FROM slots s
          SEMI JOIN kept k ON s.doc IS NOT DISTINCT FROM k.doc AND s.doc_body = k.doc_body
          AND s.item IS NOT DISTINCT FROM k.item AND s.item_body = k.item_body AND s.shift = k.shift) GROUP BY ALL),
found AS (
    SELECT c.doc, c.doc_body, c.item, c.n_windows, c.n / w.n_words AS coverage,
           coalesce(h.n_slots, 0) AS n_slots, coalesce(h.n_changed, 0) AS n_changed
    FROM covered c JOIN item_words w ON c.item IS NOT DISTINCT FROM w.id AND c.item_body = w.body
    LEFT JOIN changed h ON c.doc IS NOT DISTINCT FROM h.doc AND c.doc_body = h.doc_body
        AND c.item IS NOT DISTINCT FROM h.item AND c.item_body = h.item_body
    WHERE c.n / w.n_words >= 0.5),
plain_items AS (
    SELECT id, body, lowered, len(lowered) AS n, least(len(lowered), 8) AS k FROM typed WHERE side = 'item' AND len(lowered) > 0),
plain_item_windows AS (
    SELECT id, body, n, k, place, array_to_string(lowered[place:place + k - 1], ' ') AS code
    FROM (SELECT *, unnest(range(1, n - k + 2)) AS place FROM plain_items)),
plain_doc_windows AS (
    SELECT id, body, k, place, array_to_string(lowered[place:place + k - 1], ' ') AS code
    FROM (SELECT t.id, t.body, t.lowered, l.k, unnest(range(1, len(t.lowered) - l.k + 2)) AS place
          FROM typed t JOIN (SELECT DISTINCT k FROM plain_items) l ON l.k >= 4 OR l.k = len(t.lowered) WHERE t.side = 'doc')),
plain_met AS (
    SELECT d.id AS doc, d.body AS doc_body, i.id AS item, i.body AS item_body, i.n, i.k, i.place, d.place - i.place AS shift
    FROM plain_doc_windows d JOIN plain_item_windows i ON d.k = i.k AND d.code = i.code),
plain_lines AS (
    SELECT doc, doc_body, item, item_body, shift, count(DISTINCT place) AS n_windows,
           count(DISTINCT place + o) / any_value(n) AS coverage
    FROM plain_met JOIN range(8) r(o) ON o < k GROUP BY doc, doc_body, item, item_body, shift),
plain AS (
    SELECT doc, doc_body, item, max(n_windows) AS n_windows, max(coverage) AS coverage
    FROM plain_lines WHERE coverage >= 0.5 GROUP BY doc, doc_body, item)
SELECT doc AS doc_id, item AS item_id, n_windows, coverage, n_slots, n_changed FROM found
UNION ALL
SELECT p.doc, p.item, p.n_windows, p.coverage, 0, 0 FROM plain p
ANTI JOIN found f ON p.doc IS NOT DISTINCT FROM f.doc AND p.doc_body = f.doc_body AND p.item IS NOT DISTINCT FROM f.item
"""


def _op7_sql() -> str:
    from cohortlens.llm.decontaminate import UNITS

    return SQL_OP7.replace("UNITS", ", ".join(f"'{u}'" for u in UNITS))


@query("op7_template_decontamination", _op7_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "coverage", "n_slots",
                        "n_changed")


@query("op10_boosted_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.personal_data import digest, personal_spans

    docs = table(spark, sf_dir, "documents")
    return digest(docs, personal_spans(docs))


@query("op2_repeated_phrases")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.repeated_phrases import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "n_spans")


@query("op4_partenum_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.partenum import jaccard_join

    members, _ = jaccard_join(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: every row of these ids is a query of op11 and an anchor of op12
QUERY_STEP = 50


@query("op11_exact_search", f"""
WITH coded AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.rid AS qrid, q.vec_id AS query_id, c.rid, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM coded q JOIN coded c ON q.rid <> c.rid WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.exact_search import nearest_rows

    found = nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op12_bit_plane_negatives", f"""
WITH coded AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same,
           list_inner_product(a.v, c.v)::BIGINT AS score
    FROM coded a JOIN coded c ON a.rid <> c.rid WHERE a.vec_id % {QUERY_STEP} = 0),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.bit_planes import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, label)


@query("op13_bag_search", r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
items AS (
    SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark),
totals AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs),
norms AS (
    SELECT rid, doc_id, (75 + (25 * len(terms)::BIGINT * n_docs) // n_terms)::BIGINT AS m FROM docs, totals WHERE len(terms) > 0),
postings AS (
    SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, totals GROUP BY term),
wanted AS (
    SELECT iid, item_id, term, count(*) AS qtf FROM (SELECT iid, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scores AS (
    SELECT q.iid, any_value(q.item_id) AS item_id, p.rid, any_value(d.doc_id) AS doc_id,
           sum(q.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * d.m)))::BIGINT AS score
    FROM wanted q JOIN postings p USING (term) JOIN weights w USING (term) JOIN norms d USING (rid) GROUP BY q.iid, p.rid)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.bag_search import ranked_search

    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
