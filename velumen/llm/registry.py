"""Registered queries of the operators, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velumen.llm import chat, divergence, langid, lines, minhash, mixing, packing, repeats, resampling, sharding, tiff, toxicity, vectors
from velumen.llm.scratch import Scratch, table


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(table(spark, sf_dir, "documents"))


def op2_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role: string, content: string>>")
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(probe))
    return chat.chat_digest(chat.format_chat(turns))


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op7_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).drop("audit_recall")


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stored_digest(table(spark, sf_dir, "documents"), Scratch(spark, "store").root)


def op11_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents"), min_docs=10, min_points=1)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_nearest_centroid_language": op2_nearest_centroid_language,
    "op3_recompression_dedup": op3_recompression_dedup,
    "op4_bbit_minhash": op4_bbit_minhash,
    "op5_chat_fingerprint": op5_chat_fingerprint,
    "op6_low_discrepancy_mix": op6_low_discrepancy_mix,
    "op7_robust_pruned_graph": op7_robust_pruned_graph,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_vector_packing": op9_vector_packing,
    "op10_tiered_compaction": op10_tiered_compaction,
    "op11_bloom_line_dedup": op11_bloom_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_importance_resampling": op13_importance_resampling,
}

_OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS escaped FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(7 + length(role) + length(text) + escaped) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP6 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(list_extract([5.0, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight,
    CAST(source_size * 3 AS DOUBLE) AS most FROM per
), shared(step, source, source_size, weight, most, target, over) AS (
  SELECT 0, source, source_size, weight, most, sum(source_size) OVER () * weight / sum(weight) OVER (), false FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, weight, most,
    CASE WHEN over OR target > most THEN most ELSE
      (sum(source_size) OVER () - sum(CASE WHEN over OR target > most THEN most ELSE 0 END) OVER ()) * weight
        / nullif(sum(CASE WHEN over OR target > most THEN 0 ELSE weight END) OVER (), 0) END,
    over OR target > most
  FROM (SELECT *, bool_or(target > most AND NOT over) OVER () AS again FROM shared) WHERE again
), aims AS (
  SELECT source, source_size, round(target, 6) AS target, CAST(round(target) AS BIGINT) AS take
  FROM shared WHERE step = (SELECT max(step) FROM shared)
), line AS (
  SELECT s.*, a.source_size, a.target, a.take,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS place_at
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), counted AS (
  SELECT source, take, source_size, CAST(ceil(take / 2048) AS BIGINT) AS n, CAST(sum(CAST(ceil(take / 2048) AS BIGINT)) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS high FROM aims
), bits AS (
  SELECT max(high) AS slots, greatest(1, CAST(ceil(log2(greatest(max(high), 2))) AS INT)) AS b FROM counted
), points AS (
  SELECT slot, CAST(list_sum(list_transform(range(b), lambda k: ((slot >> k) & 1) << (b - 1 - k))) AS BIGINT) AS x
  FROM bits, LATERAL unnest(range(1 << b)) AS u(slot)
), drawn AS (
  SELECT slot, source, source_size, take, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points, bits, counted WHERE x < slots AND x >= high - n AND x < high
), parts AS (
  SELECT l.doc_id, l.source, l.size, l.place_at, slot,
    least(least((rank + 1) * 2048, d.take), r * l.source_size + place_at + size) - greatest(rank * 2048, r * l.source_size + place_at) AS words
  FROM line l JOIN drawn d ON l.source IS NOT DISTINCT FROM d.source, range(3) AS rounds(r)
  WHERE size > 0 AND least(least((rank + 1) * 2048, d.take), r * l.source_size + place_at + size) > greatest(rank * 2048, r * l.source_size + place_at)
), got AS (
  SELECT doc_id, source, size, place_at, sum(words) AS taken, min(slot) AS first_slot, sum(slot * words) AS slot_words FROM parts GROUP BY ALL
)
SELECT l.doc_id, l.size, l.source_size, l.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, l.source,
  CAST(first_slot AS BIGINT) AS first_slot, CAST(coalesce(slot_words, 0) AS BIGINT) AS slot_words
FROM line l LEFT JOIN got g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.source IS NOT DISTINCT FROM g.source AND l.size = g.size AND l.place_at = g.place_at
"""

_OP10 = """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source
FROM documents
"""

_OP3 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM docs, LATERAL unnest(range(1, len(words) - 33)) AS u(i)
), again AS (
  SELECT rid, i FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), gone AS (
  SELECT DISTINCT rid, i + k AS place FROM again, range(35) AS r(k)
), each AS (
  SELECT rid, place, words[place] AS word FROM docs, LATERAL unnest(range(1, len(words) + 1)) AS u(place)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM each ANTI JOIN gone USING (rid, place) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

_OP4 = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), shingles AS (
  SELECT DISTINCT rid, doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM docs, LATERAL unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS u(i)
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), common AS (
  SELECT a.rid AS x, b.rid AS y, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid
), links AS (
  SELECT DISTINCT a, b FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * common.n >= 75 * (p.n + q.n - common.n) AND a <> b
), reach(a, b) AS (
  SELECT DISTINCT doc_id, doc_id FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN least ON least.a = doc_id
"""

_OP7 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), usable AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reach(a, b) AS (
  SELECT DISTINCT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept,
  CASE WHEN EXISTS (SELECT 1 FROM links) THEN 1.0 ELSE CAST(NULL AS DOUBLE) END AS recall
FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT rid, i, lines[i] AS line,
    regexp_replace(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM docs, LATERAL unnest(range(1, len(lines) + 1)) AS u(i)
), doomed AS (
  SELECT key FROM each WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN doomed USING (key) GROUP BY rid
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

_OP12 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), each AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM docs
), vocabulary AS (
  SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), n AS (
  SELECT lang, source, term, count(*) AS c FROM each JOIN vocabulary USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang
), totals AS (
  SELECT lang, source, coalesce(sum(c), 0) AS total FROM groups LEFT JOIN n USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, w.term, coalesce(n.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 5)) // (g.total::HUGEINT + 5 * s.v) AS p
  FROM totals g JOIN vocabulary w ON w.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = w.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang)::HUGEINT + 5 * any_value(v)) AS q
  FROM n JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.s = a.source AND f.o = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q AS value FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p.p > q
), found AS (
  SELECT * FROM pairs UNION ALL SELECT * FROM terms
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INT), 2))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

_OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), each AS (
  SELECT rid, unnest(words) AS word FROM docs
), crc AS (
  SELECT word, xor({_CRC32.format(x="word")}, 4294967295) % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM wanted)
), s AS (
  SELECT bucket, count(*) AS n FROM each JOIN crc USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN crc USING (word) GROUP BY bucket
), sums AS (
  SELECT (SELECT count(*) FROM each) AS s_all, (SELECT count(*) FROM wanted) AS t_all
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), sums
), weights AS (
  SELECT rid, sum(g) AS w FROM each JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
  SELECT docs.*, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (rid)
), may AS (
  SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE len(words) >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN may USING (rid)
"""

ORACLES = {
    "op3_recompression_dedup": _OP3,
    "op4_bbit_minhash": _OP4,
    "op5_chat_fingerprint": _OP5,
    "op6_low_discrepancy_mix": _OP6,
    "op7_robust_pruned_graph": _OP7,
    "op10_tiered_compaction": _OP10,
    "op11_bloom_line_dedup": _OP11,
    "op12_source_divergence": _OP12,
    "op13_importance_resampling": _OP13,
}
