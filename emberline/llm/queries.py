"""The operators as queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dac, decontam, jaccard, langid, negatives, packing, pagetext, spelling, substring, topk, transducer, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """A public tokenizer file; EMBERLINE_TOKENIZERS may name another folder."""
    folder = os.environ.get("EMBERLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


CONTROL_CASE = "</s>[INST] ok [/INST]"


@_query(r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '..\0', 'g'))
          + length(regexp_replace(replace(text, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '..\0', 'g')) + 20 AS shown
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    own = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{CONTROL_CASE}' AS text "
                    f"UNION ALL SELECT -7L, 1L, 'assistant', '{CONTROL_CASE}'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.conversation_digests(chat.format_conversations(rows, path), path)
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@_query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))
    return done.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@_query()
def op3_pack_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query()
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = dac.write_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return dac.read_documents(manifest)


@_query(r"""
WITH payload AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
named AS (SELECT page_id, octet_length(p)::BIGINT AS n, sha1(p) AS h, max(page_id) OVER (PARTITION BY p) AS top FROM payload),
quintets AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT) AS five FROM named)
SELECT page_id::BIGINT AS page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((five[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END::BIGINT AS refers_to
FROM quintets
""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query(r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-`{-\x7F]+') AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT r, list_slice(w, i, i + 4) AS s FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM worded WHERE len(w) > 0)),
numbered AS MATERIALIZED (SELECT r, dense_rank() OVER (ORDER BY s) AS s FROM shingle),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM numbered GROUP BY r),
link AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS common FROM numbered x JOIN numbered y ON x.s = y.s AND x.r <> y.r GROUP BY ALL) c
  JOIN size m ON c.a = m.r JOIN size n ON c.b = n.r WHERE 5 * c.common >= 4 * (m.n + n.n - c.common)),
reach AS (SELECT r, r AS other FROM worded UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.other = link.a),
class AS (SELECT reach.r, min(w.doc_id) AS class_id FROM reach JOIN worded w ON reach.other = w.r GROUP BY reach.r),
linked AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT w.doc_id::BIGINT AS doc_id, c.class_id::BIGINT AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM worded w JOIN class c ON w.r = c.r LEFT JOIN linked l ON w.r = l.r
""")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


@_query("""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@_query()
def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


@_query(r"""
WITH worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS win
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
lost AS MATERIALIZED (
  SELECT r, i FROM windows JOIN firsts USING (win) WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM lost),
split AS (SELECT r, k, word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM worded)),
kept AS (
  SELECT split.r, array_to_string(list(word ORDER BY split.k), ' ') AS text FROM split
  LEFT JOIN gone ON split.r = gone.r AND split.k = gone.k WHERE gone.r IS NULL GROUP BY split.r),
counted AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (r) LEFT JOIN counted USING (r)
""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM sound a JOIN sound c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
placed AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM placed p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrupted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", corrupted))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@_query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


@_query(r"""
WITH RECURSIVE table_ AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
  FROM documents),
counted AS MATERIALIZED (SELECT doc_id, w, count(*) AS c FROM run WHERE length(w) >= 6 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
      lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM counted), table_),
words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
named AS (SELECT b.word, b.n_near, b.top, min(x.near) AS near FROM best b JOIN near x ON x.word = b.word AND x.near_n = b.top GROUP BY ALL),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(d.n_near, 0)::BIGINT AS n_near, CASE WHEN d.top >= 5 * w.n THEN d.near END AS form,
    CASE WHEN d.top >= 5 * w.n THEN d.top END AS form_n FROM words w LEFT JOIN named d ON w.word = d.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents")).where(F.length("run") >= 6)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.crc32(F.concat(doc, F.lit(":"), "run").cast("binary"))
    gone = (h % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = spelling.vocabulary(found.select(F.when(h % 199 == 0, left).otherwise(F.col("run")).alias("word")))
    return spelling.group_variants(words)
