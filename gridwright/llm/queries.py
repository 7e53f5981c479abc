"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import bpe, jaccard, mixing, packing, page_text, preference, ranked_search, secret_scan, toxicity, vector_codes, voronoi, warc, winnowing
from gridwright.llm.frames import read_table
from gridwright.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan(read_table(spark, sf_dir, "documents")))


def secret_model(docs: DataFrame) -> secret_scan.SecretModel:
    """Fit on findings of a bounded sample of documents, labelled where there is evidence, and on invented ones."""
    sample = secret_scan.sample_of(docs)
    dictionary = secret_scan.dictionary_of(docs)
    found = secret_scan.by_evidence(checkpoint(secret_scan.findings(sample, dictionary))).select("features", "label")
    invented = docs.sparkSession.createDataFrame(secret_scan.made_up(dictionary), "features array<double>, label int")
    return secret_scan.fit(found.unionByName(invented), dictionary)


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_model(docs))


JACCARD_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op6_ngram_jaccard", JACCARD_SQL)
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


@query("op10_winnowing")
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(read_table(spark, sf_dir, "documents"))


def _mask_text(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")


_RENDER = "'<|' || role || '|>' || chr(10) || {} || '<|end|>' || chr(10)"


def _side_sql(name: str) -> str:
    """Completion and mask of one side: offsets of the turns from the first other one on, as running sums."""
    return f"""{name} AS (SELECT conv_id, string_agg(part, '' ORDER BY turn) AS body,
  string_agg(CASE WHEN role = 'assistant' THEN (begun + length(role) + 5) || ':' || (begun + length(part) - 1) END, ' ' ORDER BY turn) AS mask
  FROM (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
    FROM (SELECT conv_id, turn, role, {_RENDER.format(name + '_text')} AS part FROM marked WHERE turn >= diff)) GROUP BY conv_id)"""


PREFERENCE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS good_text FROM conversations),
f AS (SELECT conv_id, max(turn) AS last, min(turn) AS first, arg_min(good_text, turn) AS first_text FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.*, CASE WHEN role = 'assistant' AND turn = last THEN CASE WHEN first < last AND first_text <> good_text THEN first_text
  ELSE left(good_text, length(good_text) // 2) END ELSE good_text END AS bad_text FROM t LEFT JOIN f USING (conv_id)),
d AS (SELECT conv_id, min(turn) FILTER (WHERE good_text <> bad_text) AS diff FROM r GROUP BY conv_id),
marked AS (SELECT r.*, d.diff FROM r JOIN d USING (conv_id)),
p AS (SELECT conv_id, coalesce(string_agg({_RENDER.format('good_text')}, '' ORDER BY turn) FILTER (WHERE diff IS NULL OR turn < diff), '') AS prompt,
  CAST(count(*) FILTER (WHERE diff IS NULL OR turn < diff) AS INTEGER) AS prompt_turns FROM marked GROUP BY conv_id),
{_side_sql('good')}, {_side_sql('bad')}
SELECT conv_id, prompt, prompt_turns, coalesce(good.body, '') AS chosen, coalesce(good.mask, '') AS chosen_mask,
  coalesce(bad.body, '') AS rejected, coalesce(bad.mask, '') AS rejected_mask
FROM p LEFT JOIN good USING (conv_id) LEFT JOIN bad USING (conv_id)"""


@query("op1_preference", PREFERENCE_SQL)
def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return preference.format_pairs(turns, preference.weakened(turns, "conv_id"), "conv_id").select(
        F.col("pair").alias("conv_id"), "prompt", "prompt_turns", "chosen", _mask_text("chosen_mask").alias("chosen_mask"),
        "rejected", _mask_text("rejected_mask").alias("rejected_mask"))


WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


@query("op4_warc", WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(read_table(spark, sf_dir, "pages"))).drop("url")


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.whole, c.whole) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.whole) = len(c.whole))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op2_voronoi_top_k", TOP_K_SQL)
def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return voronoi.top_k(vectors, F.col("vec_id") % 50 == 0, 5, "vec_id", voronoi.scaled("embedding", 256)).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op3_page_text")
def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), path)
    return bpe.decode(encoded, bpe.pieces(spark, path)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


_NEAREST = """{to} AS MATERIALIZED (SELECT vec_id, part, x, key % 64 AS entry, key // 64 AS dist FROM (
  SELECT vec_id, part, any_value(x) AS x, min(64 * CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) + entry) AS key
  FROM p JOIN {books} USING (part) GROUP BY vec_id, part))"""
_MEANS = """{to} AS MATERIALIZED (SELECT part, entry, coalesce(mean, c) AS c FROM {books} LEFT JOIN (
  SELECT part, entry, list(m ORDER BY j) AS mean FROM (SELECT part, entry, j, floor(sum(x[j]) / count(*)) AS m FROM {near}, range(1, 5) r(j) GROUP BY part, entry, j)
  GROUP BY part, entry) USING (part, entry))"""
CODES_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, whole[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),
{_NEAREST.format(to='n0', books='b0')}, {_MEANS.format(to='b1', books='b0', near='n0')},
{_NEAREST.format(to='n1', books='b1')}, {_MEANS.format(to='b2', books='b1', near='n1')}, {_NEAREST.format(to='n2', books='b2')},
s AS (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b2, range(1, 5) r(j)),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), s"""


@query("op13_vector_codes", CODES_SQL)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    return vector_codes.with_label_errors(vector_codes.compress(vectors, books)).select(
        F.col("id").alias("vec_id"), F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "").alias("code"),
        "error", "label_error", F.lit(books.digest if books else None).cast("string").alias("codebooks_sha256"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ranked_search.CAPITALS}', '{ranked_search.SMALL}'), '{ranked_search.TERM}')"
RANKED_SQL = rf"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
