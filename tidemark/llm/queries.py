"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exactdedup, html, jaccard, linededup, merkle, mixing, periodic, quality, sharding, topk, toxicity
from tidemark.llm.common import table


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has that of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # Size and checksum are taken before the exchange, so that texts don't travel.
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard_documents(docs, n_shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)
    return (
        mixed.groupBy("row_key", "doc_id", "size", "source_size", "target")
        .agg(F.sum("n_words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return quality.score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


#: Every row whose id is divisible by 20 is a query, against all rows.
def asks() -> Column:
    return F.expr("coalesce(vec_id % 20 = 0, false)")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), asks(), k=20)


OP5_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85).select(
        "doc_id", "n_shingles", "component_id"
    )


OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), asks(), k=20)


OP8_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), spread AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN spread USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    )
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: where 10 divides the checksum h of the id, the words from a on repeat with period p.

    g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8), for n words. Texts without words, and rows without an id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, split).alias("words"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    rows = rows.withColumn("a", F.when(F.size("words") > 0, (F.col("g") % F.size("words")).cast("int")))
    rows = rows.withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)"))
    # 3 + g % 8 periods reach the end of the text.
    unit = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast(3 + g % 8 as int)"))
    periodic = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(unit)), F.lit(1), F.size("words"))
    return rows.select("doc_id", F.coalesce(F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")), "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_periods(table(spark, sf_dir, "documents")), min_length=6, min_periods=4)
    first = F.col("runs")[0]
    # The greatest length / period, compared exactly; runs come by start and period, so of equals the first stays.
    best = F.when(
        F.size("runs") > 0,
        F.aggregate("runs", first, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)),
    )
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    row = [F.col(c) for c in names]
    # Where 7 divides the checksum of the id, the row has been tampered with: n_chars is one more, if there is any.
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = [*row[:3], more, row[4]]
    found = (remainder(F.col("doc_id"), 7) == 0) & F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull()
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", merkle.leaf_digest(*row).alias("leaf"), F.when(found, merkle.leaf_digest(*tampered)).alias("changed")
    )
    claimed = leaves.withColumn("claim", F.coalesce("changed", "leaf")).drop("changed")
    return merkle.manifest(claimed, "lang", "doc_id", "leaf", "claim", fanout=2)


#: Levels as lists that halve; the checksum of an id is worked out bit by bit, as there is no function for it.
OP12_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::BIGINT) % 7 = 0 AS tampered
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(length((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || tail) AS claim,
         coalesce('=' || lang, '') AS tree
  FROM fields
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM leaves),
levels AS (
  SELECT tree, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM levels WHERE len(nodes) > 1
), subroots AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM tops WHERE len(nodes) > 1
), below AS (SELECT tree, list(nodes ORDER BY lvl) FILTER (len(nodes) > 1) AS levels FROM levels GROUP BY tree),
over AS (SELECT list(nodes ORDER BY lvl) FILTER (len(nodes) > 1) AS levels, max(nodes[1]) FILTER (len(nodes) = 1) AS root FROM tops),
paths AS (
  SELECT p.doc_id, p.leaf, p.claim, s.subroot, o.root,
         list_concat(list_transform(coalesce(b.levels, []), lambda n, i: {'s': coalesce(n[xor(p.pos >> (i - 1), 1) + 1], ''), 'first': (p.pos >> (i - 1)) & 1 = 1}),
                     list_transform(coalesce(o.levels, []), lambda n, i: {'s': coalesce(n[xor(s.pos >> (i - 1), 1) + 1], ''), 'first': (s.pos >> (i - 1)) & 1 = 1})) AS path
  FROM placed p JOIN subroots s USING (tree) JOIN below b USING (tree), over o
), folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda x: x.s), '')) AS proof_sha256,
         list_reduce(list_prepend({'s': claim, 'first': false}, path),
           lambda a, x: {'s': sha256(CASE WHEN x.first THEN x.s || a.s ELSE a.s || x.s END), 'first': false}).s AS folded_root
  FROM paths
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Texts become digests before anything is kept or exchanged.
    digests = docs.select("doc_id", exactdedup.text_digest(F.col("text")).alias("text_sha256"))
    return exactdedup.mark_duplicates(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_mixing": op2_mixing,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_top_k": op5_top_k,
        "op6_line_dedup": op6_line_dedup,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_nearest": op8_nearest,
        "op9_main_text": op9_main_text,
        "op10_bpe": op10_bpe,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_merkle": op12_merkle,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_top_k": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op8_nearest": OP8_SQL, "op12_merkle": OP12_SQL, "op13_exact_dedup": OP13_SQL}
