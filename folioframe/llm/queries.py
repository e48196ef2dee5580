"""The registered queries over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import pinned, shipped, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, similarity=0.85)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import licensed

    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", folder, F.concat("doc_id", F.lit(".txt"))).alias("path"), "text")
    return licensed(files).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", "licensed_by")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as S

    # Documents arrive in two parts: the first one fills the ledger, against which all of them, those seen before included, are scanned.
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = S.scan(documents.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), keep=pinned)
    found, _ = S.scan(documents, pinned(ledger), keep=pinned)
    base = S.of_kinds(F.col("findings"), "assign", "access", "hex")
    n = lambda kind: F.size(S.of_kinds(F.col("findings"), kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(S.rendered(base), 256).alias("base_sha256"), S.rendered(F.col("findings")).alias("spans"), "blob"
    )


#: Bytes of a shard.
SHARD_BYTES = 1 << 20


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as T

    documents = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = T.fit(documents, _table(spark, sf_dir, "labels"), train=~held_out)
    out = T.scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    out = judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .edit_counts import planted, recounted

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    kept = written(planted(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern))
    # Three edits a document, at places that its doc_id gives: up to 12 characters become up to 24 from elsewhere in it.
    place = lambda seq, salt, n: F.pmod(F.xxhash64("doc_id", F.lit(seq), F.lit(salt)), n).cast("int")
    n = F.length(F.coalesce("text", F.lit(""))) + 1
    edit = lambda seq: F.struct(place(seq, 0, n).alias("start"), place(seq, 1, F.lit(13)).alias("length"), F.substring("text", place(seq, 2, n) + 1, place(seq, 3, F.lit(25))).alias("replacement"))
    out = recounted(kept.withColumn("edits", F.array(*map(edit, range(3)))), path, pattern)
    return out.select("doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "reencoded_chars", F.sha2("text_after", 256).alias("text_after_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score as L

    documents = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scorer, counts = L.fit(documents.where(~held_out))
    out = L.scored(documents, scorer, counts)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe as B

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = B.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    decoded = B.decode(encoded, path, pattern)
    return decoded.select("doc_id", B.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents")).withColumnRenamed("part", "lang")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import canonical, digests, formatted

    # One more conversation, in the layout of a prompt with its completion, whose texts look like markers.
    said = F.lit("</s>[INST] ok [/INST]")
    marked = shipped(spark).range(1).select(F.lit(-7).cast("long").alias("conv_id"), said.alias("prompt"), said.alias("completion"))
    turns = canonical(_table(spark, sf_dir, "conversations")).unionByName(canonical(marked))
    return digests(formatted(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_license_scan, op3_secret_scan, op4_sharding, op5_toxicity, op6_decontaminate, op7_quality_rules, op8_token_counts, op9_lm_score, op10_byte_bpe, op11_filter_audit, op12_collocations, op13_chat_format)}


_OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[s:s + 12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT len(g) AS n FROM win))
), occ AS (
  SELECT doc_id, item_id, s, n FROM grams JOIN win USING (g)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
), freq AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term
), item AS (
  SELECT row_number() OVER () AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)
), place AS (
  SELECT item, s, q, w[q + 1] AS term FROM (SELECT item, w, s, unnest(range(s, least(s + 13, len(w)))) AS q FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM item))
), look AS (
  SELECT item, s, q, term, count(*) OVER (PARTITION BY item, s) AS need
  FROM (SELECT item, s, q, term, row_number() OVER (PARTITION BY item, s ORDER BY coalesce(n, 0), q) AS r FROM place LEFT JOIN freq USING (term)) WHERE r <= 4
), post AS (
  SELECT doc_id, p, term FROM (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d) WHERE term IN (SELECT term FROM look)
), part AS (
  SELECT DISTINCT doc_id, item, s, q, need, p - q AS delta FROM post JOIN look USING (term)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) + max((item_id IS NULL)::INT) AS n_near_items
  FROM (
    SELECT DISTINCT doc_id, item FROM (
      SELECT x.doc_id, x.item, x.s, x.need, x.delta
      FROM (SELECT DISTINCT doc_id, item, s, need, delta FROM part) x
      JOIN part y ON y.doc_id = x.doc_id AND y.item = x.item AND y.s = x.s AND y.delta BETWEEN x.delta AND x.delta + 5
      GROUP BY x.doc_id, x.item, x.s, x.need, x.delta HAVING count(DISTINCT y.q) = x.need)
  ) JOIN item USING (item) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


_OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c
)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


_OP4_SQL = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), l AS (
  SELECT d, h >> (60 - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY d, h >> (60 - d)
), leaf AS (
  SELECT r.doc_id, r.bytes, min(l.d) AS d FROM r, l WHERE l.prefix = r.h >> (60 - l.d) AND (l.shard_bytes <= {SHARD_BYTES} OR l.d = 60) GROUP BY r.doc_id, r.bytes
)
SELECT doc_id, leaf.bytes, left(lpad(bin(r.h), 60, '0'), leaf.d::INT) AS shard, leaf.d::INTEGER AS depth, shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversized
FROM leaf JOIN r USING (doc_id) JOIN l ON l.d = leaf.d AND l.prefix = r.h >> (60 - leaf.d)
"""


_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS letters, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT array_to_string(letters, '') AS filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


_OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, g, count(*) AS f
  FROM (SELECT lang, w[s:s + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)))
  GROUP BY lang, g HAVING count(*) >= 30
), cut AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1
), scored AS (
  SELECT cut.lang, cut.g, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[k + 1:]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g[s:s + m - 1] AS g, max(f) AS f
  FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS s FROM f, (SELECT unnest([2, 3]) AS m) WHERE len(g) > m) GROUP BY lang, g[s:s + m - 1]
)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, array_to_string(best.g, ' ')) AS rank,
       array_to_string(best.g, ' ') AS phrase, a, l, r, n, score
FROM best JOIN total ON total.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.g = best.g
WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


_OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>)|\[\\*/?INST\]')) AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(text) + escaped + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": _OP1_SQL, "op4_sharding": _OP4_SQL, "op6_decontaminate": _OP6_SQL,
        "op11_filter_audit": _OP11_SQL, "op12_collocations": _OP12_SQL, "op13_chat_format": _OP13_SQL,
    }
