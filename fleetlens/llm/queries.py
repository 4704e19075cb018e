"""The registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, contamination, language, licenses, lines, minhash, negatives, quality, rules, secrets, simhash, trie, warc
from fleetlens.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > o.owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM o
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination.matches(docs, table(spark, sf_dir, "benchmark"))
    by_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"), F.round(F.max("similarity"), 9).alias("similarity"))
    every = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return every.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("n_items").isNull().alias("kept"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["word"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("notices", lambda n: n["label"])
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda n: n["likeness"])), F.lit(0.0)))
    return got.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), score.alias("score"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = language.fit(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    got = language.predict(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM t),
c AS (SELECT doc_id, len(sh) AS n, sh, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS node FROM s),
e AS (SELECT doc_id, n, unnest(sh) AS x FROM c WHERE doc_id = node AND n > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM c WHERE doc_id = node UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS comp FROM r GROUP BY a)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, m.comp AS component_id, c.doc_id = m.comp AS kept FROM c JOIN m ON c.node = m.a
"""


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST) AS s FROM t GROUP BY conv_id),
b AS (SELECT *, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS bits FROM o),
h AS (SELECT conv_id, s, xor(list_reduce(bits, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END,
    4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM b),
z AS (SELECT h.conv_id, list_concat(coalesce(l.s, [])[1:h.h], h.s[h.h + 1:]) AS s FROM h LEFT JOIN o l ON l.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, s, len(s) AS n, unnest(generate_series(0, len(s))) AS d FROM z),
q AS (SELECT s[1:d] AS k, d, min(conv_id) AS c, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends
    FROM p GROUP BY 1, 2),
c AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM q WHERE d > 0 GROUP BY 1),
w AS (SELECT q.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(q.k[d].x)) ELSE 0 END AS own
    FROM q LEFT JOIN c ON q.k = c.k),
u AS (SELECT k, unnest(generate_series(0, d)) AS top, n_children = 0 AS leaf, own FROM w),
v AS (SELECT k[1:top] AS k, count(*) FILTER (leaf) AS n_leaves, sum(own)::BIGINT AS saved FROM u GROUP BY 1)
SELECT w.c::BIGINT AS conv_id, w.d::BIGINT AS depth, e.c::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
    v.n_leaves::BIGINT AS n_leaves, v.saved AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN v ON w.k = v.k LEFT JOIN q e ON w.d > 0 AND e.k = w.k[1:w.d - 1]
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH f AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM f),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS positive_id, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p AS positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p <= 100 * score AND 100 * score <= 90 * p
WINDOW w AS (PARTITION BY p.a, positive_id ORDER BY score DESC, s.b) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_secrets": op2_secrets, "op3_line_dedup": op3_line_dedup, "op4_warc": op4_warc, "op5_quality_classifier": op5_quality_classifier, "op6_decontamination": op6_decontamination, "op7_licenses": op7_licenses, "op8_language": op8_language, "op9_quality_rules": op9_quality_rules, "op10_minhash": op10_minhash,
            "op11_simhash": op11_simhash, "op12_trie": op12_trie, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op10_minhash": OP10_SQL, "op12_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
