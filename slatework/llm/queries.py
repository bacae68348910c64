"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import credentials, divergence, edits, langid, media, neardup, negatives, packing, pieces, quality, substrings, vectors, warc
from slatework.llm.common import materialize


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near copies by three-word shingles and Jaccard 0.85."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")


#: From links to components, by repeated minima over the links.
_COMPONENTS = """
walk(id, reached) AS (SELECT id, id FROM nodes UNION SELECT walk.id, links.b FROM walk JOIN links ON walk.reached = links.a),
component AS (SELECT id, min(reached) AS component_id FROM walk GROUP BY id)
"""

OP1_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component c ON c.id = d.doc_id
"""


def made_edits() -> Column:
    """Three edits of a document, from hashes of its doc_id: a place, a length and some of its own text."""
    n = F.length(F.coalesce("text", F.lit("")))

    def draw(k: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(k), "doc_id"), below)

    one = [F.struct(draw(3 * k, n + 1).alias("start"), draw(3 * k + 1, F.lit(60)).alias("length"), F.substring("text", draw(3 * k + 2, n + 1).cast("int") + 1, F.lit(50)).alias("replacement")) for k in range(3)]
    return F.array(*one)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count before and after edits, and the characters encoded anew."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", made_edits())
    path = tokenizer_path("byte_bpe_50k.json")
    trees = edits.build_trees(docs, path).withColumn("n_tokens_before", F.col("n_tokens"))
    done = edits.apply_edits(trees, path)
    return done.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), F.col("tree_chars")[1].alias("n_chars_after"), "chars_reencoded", F.sha2("text", 256).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every packed document, with the checksum of its ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums and features of every document stored as telephony audio: the files are written, and
    what is read back is decoded and resampled."""
    stored = materialize(media.encode_media(_table(spark, sf_dir, "documents")), "media")
    return media.digest(media.decode_media(stored))


#: Production parameters of the substring operator: whatever the place of a passage of 50 words or
#: more, at most 16 words at either end of it stay.
PASSAGES = {"run": 2, "least_words": 15}


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages each document lost, and a checksum of what is left of it."""
    cleaned = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), **PASSAGES)
    return cleaned.select("doc_id", "n_sentences", "n_removed", "removed_spans", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links at cosine 0.95 and its component."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM v),{_COMPONENTS}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN component c ON c.id = v.vec_id
"""


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents that are not held out, at most 400 of each language."""
    return langid.train(langid.sample(docs.filter(~held_out()), per_lang=400))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by the words' posteriors."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "known")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces under merge-dropout: their number, a hash, and whether they decode to
    the document."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.decode(pieces.encode(docs, path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, as read back from the archives."""
    archives = materialize(warc.write_archives(warc.resolve(_table(spark, sf_dir, "pages"))), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""

#: Production parameter of the quality operator: the share of the documents that the sample takes.
SHARE = 0.5


def op10_quality(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Every document's importance weight and whether it is in the sample of half of the documents
    that Gumbel top-k draws by these weights."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit(docs, _table(spark, sf_dir, "labels"))
    keyed = materialize(quality.perturb(quality.score(docs, ratio), seed=seed).drop("text"), "weights")
    least = quality.threshold(keyed, round(keyed.count() * SHARE))
    return keyed.withColumn("kept", F.col("gumbel_key") >= least)

def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and their ten most telling terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
one AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM one GROUP BY ALL HAVING count(*) >= 10),
counts AS (SELECT lang, source, term, sum(n) AS n FROM one SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
words AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM words),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets: how many are spelled so, a checksum of their places, and all places."""
    found = credentials.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = credentials.spelled(kinds=credentials.KINDS[:3])
    counts = [credentials.count_of(k).alias(f"n_{k}") for k in credentials.KINDS]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), credentials.spelled().alias("spans"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels being moved by one."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash, op2_token_counts, op3_packing, op4_media, op5_substrings, op6_embeddings, op7_language_id, op8_pieces, op9_warc, op10_quality, op11_divergence, op12_secrets, op13_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op6_embeddings": OP6_SQL, "op9_warc": OP9_SQL, "op11_divergence": OP11_SQL, "op13_negatives": OP13_SQL}
