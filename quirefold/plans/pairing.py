"""Joins on stems and what is left to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions.metrics import unmatched_share, wer
from quirefold.operators import joins, reports, samples
from quirefold.plans.registry import by_bytes, query, read, read_dealt, trimmed


@query("""
WITH x AS (SELECT conv_id AS stem, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id)
SELECT coalesce(role, 'xml_puudub') AS outcome, count(*) AS n FROM documents d LEFT JOIN x ON x.stem = d.doc_id GROUP BY outcome
""")
def stem_join(spark, sf_dir):
    images = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"))
    documents = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stem"), "turn", "role")
    found = joins.with_document(images, documents, "stem", "turn")
    return found.groupBy(F.when(F.col("has_document"), F.col("role")).otherwise("xml_puudub").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def stem_pairs(spark, sf_dir):
    return joins.pairs(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, l.quality, b.item_id IS NOT NULL AS has_text FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def sidecar_join(spark, sf_dir):
    texts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("t"))
    found = joins.with_sidecars(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", json=read(spark, sf_dir, "labels").select("doc_id", "quality"), txt=texts)
    return found.select("doc_id", "quality", F.coalesce("t", F.lit(False)).alias("has_text"))


@query("SELECT c_custkey AS page, c_nationkey AS work, n_name AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def work_metadata_join(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("work"))
    return joins.with_work(pages, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("work"), F.col("n_name").alias("label")))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def with_image(spark, sf_dir):
    return joins.having(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_backlog(spark, sf_dir):
    return joins.lacking(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


def _pairs(docs):
    truth = docs.select("doc_id", "source", F.col("text").alias("truth"))
    guess = F.replace(F.replace("truth", F.lit("th"), F.lit("t")), F.lit("an"), F.lit("en"))
    guesses = truth.where("doc_id % 7 <> 0").select("doc_id", guess.alias("guess"))
    return joins.with_guess(truth, guesses, "doc_id", F.col("truth"))


def _rates(pairs):
    return reports.error_rates(pairs, "truth", "guess", words=False)


def _by(rates, key):
    found = reports.macro_average(rates, key)
    return found.withColumn("mean_cer", F.round("mean_cer", 9))


def _of_models(pairs):
    guesses = pairs.where("status = 'ok'").select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "guess")
    return joins.every_model(pairs.select("doc_id", "source", "truth"), guesses, "doc_id", F.col("truth"))


# Error rates of whole tables against the same texts with letters dropped and changed. In the SQL, each pair's non-ASCII characters become ASCII characters that the pair doesn't
# hold, one for one, which leaves the distance as it is; where there are too few of them, the SQL fails.
_WHOLE = rf"""
WITH p AS (SELECT doc_id, source, {trimmed("text")} AS truth, CASE WHEN doc_id % 7 <> 0 THEN {trimmed("replace(replace(text, 'th', 't'), 'an', 'en')")} END AS guess FROM documents WHERE {trimmed("text")} <> ''),
c AS (SELECT *, {by_bytes("truth", "guess")} AS d FROM p),
e AS (SELECT doc_id, source, CASE WHEN guess IS NULL THEN 'puudub' ELSE 'ok' END AS status, CASE WHEN guess IS NULL THEN NULL WHEN truth = '' THEN (guess <> '')::INT::DOUBLE ELSE d / length(truth) END AS cer FROM c)
"""
_MEANS = "count(*) FILTER (WHERE status = 'ok') AS pages, count(*) FILTER (WHERE status <> 'ok') AS missing, round(avg(cer), 9) AS mean_cer"


@query(_WHOLE + "SELECT doc_id, status, round(cer, 9) AS cer FROM e")
def cer_all(spark, sf_dir):
    return _rates(_pairs(read(spark, sf_dir, "documents"))).select("doc_id", "status", F.round("cer", 9).alias("cer"))


@query(_WHOLE + f"SELECT source, {_MEANS} FROM e GROUP BY source")
def cer_macro_by_source(spark, sf_dir):
    return _by(_rates(_pairs(read(spark, sf_dir, "documents"))), "source")


@query(_WHOLE + f"SELECT model, {_MEANS} FROM e, (VALUES ('a'), ('b')) v(model) GROUP BY model")
def cer_every_model(spark, sf_dir):
    return _by(_rates(_of_models(_pairs(read(spark, sf_dir, "documents")))), "model")


def _heard(turns):
    """Turns as truth and a guess with words dropped and changed; every seventh conversation has none."""
    guess = F.replace(F.replace("text", F.lit(" the "), F.lit(" ")), F.lit("an"), F.lit("en"))
    turns = turns.withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    guesses = turns.where("conv_id % 7 <> 0").select("id", guess.alias("guess"))
    return joins.with_guess(turns, guesses, "id", F.col("text"))


@query()
def error_rates_by_role(spark, sf_dir):
    """Means of both rates over the turns of each role; no SQL twin, as DuckDB has no edit distance of lists."""
    found = reports.macro_average(reports.error_rates(_heard(read(spark, sf_dir, "conversations")), "text", "guess"), "role")
    return found.withColumns({c: F.round(c, 9) for c in ("mean_cer", "mean_wer")})


@query()
def wer_all(spark, sf_dir):
    """Every turn, of any length; no SQL twin, as DuckDB has no edit distance of lists."""
    guess = F.replace(F.replace("text", F.lit(" the "), F.lit(" ")), F.lit("an"), F.lit("en"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(wer(F.col("text"), guess), 9).alias("wer"))


@query()
def unmatched_all(spark, sf_dir):
    """The diagnostic share of each text that is in no matching block; no SQL twin, as DuckDB has no matching blocks."""
    guess = F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("an"), F.lit("en"))
    return read_dealt(spark, sf_dir, "documents").select("doc_id", F.round(unmatched_share(F.col("text"), guess), 9).alias("unmatched"))


@query("SELECT source, count(*) FILTER (WHERE n_chars % 3 <> 0) AS succeeded, count(*) FILTER (WHERE n_chars % 3 = 0) AS failed FROM documents GROUP BY source")
def outcome_totals(spark, sf_dir):
    return reports.outcomes(read(spark, sf_dir, "documents"), F.col("n_chars") % 3 != 0, "source")


@query("""
SELECT doc_id, i AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role, j AS part, CASE WHEN i = 0 AND j = 1 THEN 'image' ELSE 'text' END AS type,
CASE WHEN i = 1 THEN text WHEN j = 0 THEN 'Transcribe.' END AS text, CASE WHEN i = 0 AND j = 1 THEN 'images/' || doc_id || '.jpg' END AS image
FROM documents, (VALUES (0, 0), (0, 1), (1, 0)) v(i, j)
""")
def conversation_samples(spark, sf_dir):
    messages = samples.conversation(F.lit("Transcribe."), F.concat(F.lit("images/"), F.col("doc_id"), F.lit(".jpg")), F.col("text"))
    turns = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(messages).alias("turn", "m"))
    return turns.select("doc_id", "turn", "m.role", F.posexplode("m.content").alias("part", "p")).select("doc_id", "turn", "role", "part", "p.type", "p.text", "p.image")
