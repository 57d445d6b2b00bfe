"""Audits of markup, lengths and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import markup
from quirefold.functions.metrics import cer, tag_accuracy
from quirefold.operators import reports
from quirefold.plans.registry import by_bytes, query, read, read_dealt, trimmed


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return reports.group_count(read(spark, sf_dir, "documents"), "source")


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source")
def source_share(spark, sf_dir):
    return reports.shares(read(spark, sf_dir, "documents"), "source").withColumn("share", F.round("share", 9))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_projects(spark, sf_dir):
    return reports.top_groups(read(spark, sf_dir, "documents"), "source")


@query("SELECT count(DISTINCT source) AS projects, count(*) AS pages FROM documents")
def project_total(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("projects"), F.count(F.lit(1)).alias("pages"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS work, count(*) AS pages FROM pages GROUP BY work")
def directory_totals(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("work")).agg(F.count(F.lit(1)).alias("pages"))


@query(r"""
WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z0-9]+)\s*/?>', 1))) AS tag FROM pages)
SELECT tag, count(*) AS openers, count(DISTINCT page_id) AS pages FROM t GROUP BY tag
""")
def tag_census(spark, sf_dir):
    return reports.tag_census(read(spark, sf_dir, "pages"), "page_id", "html")


_BROKEN = "left(text, (length(text) * (doc_id % 5 + 3) // 10)::INT) || '<pb/>' || substr(text, (length(text) * (doc_id % 5 + 3) // 10)::INT + 1)"


@query(f"""
WITH p AS (SELECT {_BROKEN} AS t FROM documents), q AS (SELECT (instr(t, '<pb/>') - 1) / length(t) AS p FROM p)
SELECT count(*) AS pages, round(median(p), 9) AS median, round(quantile_cont(p, 0.25), 9) AS low, round(quantile_cont(p, 0.75), 9) AS high FROM q
""")
def pb_position(spark, sf_dir):
    at = F.floor(F.length("text") * (F.col("doc_id") % 5 + 3) / 10).cast("int")
    page = F.concat(F.substring("text", F.lit(1), at), F.lit("<pb/>"), F.substring("text", at + 1, F.length("text")))
    found = reports.break_position(read(spark, sf_dir, "documents").select(page.alias("t")), "t")
    return found.select("pages", *(F.round(c, 9).alias(c) for c in ("median", "low", "high")))


_NOTES = "'<m>' || replace(replace(text, '. ', '.</m> <m>'), ',', CASE WHEN doc_id % 4 = 0 THEN '<m>' ELSE ',' END) || '</m>'"


@query(rf"""
WITH p AS (SELECT source, {_NOTES} AS t FROM documents),
q AS (SELECT source, len(regexp_extract_all(t, '<m>')) AS o, len(regexp_extract_all(t, '</m>')) AS c, regexp_extract_all(t, '(?s)<m>(.*?)</m>', 1) AS ps FROM p)
SELECT source, sum(o)::BIGINT AS opened, sum(c)::BIGINT AS closed, sum(len(list_filter(ps, lambda x: NOT contains(x, chr(10)))))::BIGINT AS single, sum(len(list_filter(ps, lambda x: contains(x, chr(10)))))::BIGINT AS multi, count(*) FILTER (WHERE o <> c) AS unbalanced FROM q GROUP BY source
""")
def marginalia_audit(spark, sf_dir):
    comma = F.when(F.col("doc_id") % 4 == 0, "<m>").otherwise(",")
    page = F.concat(F.lit("<m>"), F.replace(F.replace("text", F.lit(". "), F.lit(".</m> <m>")), F.lit(","), comma), F.lit("</m>"))
    return reports.note_audit(read(spark, sf_dir, "documents").select("source", page.alias("t")), "t", "source")


_NOTED = "'<m>' || replace(text, '. ', '.</m> <m>') || '</m>'"


@query(rf"""
WITH p AS (SELECT date_trunc('month', ts)::DATE AS month, regexp_extract_all({_NOTED}, '(?s)<m>(.*?)</m>', 1) AS ps FROM documents JOIN events ON event_id = doc_id),
n AS (SELECT month, sum(len(ps))::BIGINT AS pairs, sum(len(list_filter(ps, lambda x: contains(x, chr(10)))))::BIGINT AS multi FROM p GROUP BY month)
SELECT month, pairs - multi AS single, multi, round(multi / pairs, 9) AS share FROM n
""")
def multiline_by_month(spark, sf_dir):
    """Every sentence a note; the time of a document is that of the event of its number."""
    page = F.concat(F.lit("<m>"), F.replace("text", F.lit(". "), F.lit(".</m> <m>")), F.lit("</m>"))
    pages = read(spark, sf_dir, "documents").select("doc_id", page.alias("t")).join(read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    return reports.multiline_share(pages, "t", "ts").withColumn("share", F.round("share", 9))


@query("SELECT count(*) AS images, round(median((p_partkey * 37 % 9000 + 1) / (p_size * 211 + 300)), 9) AS median FROM part")
def aspect_ratio(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").select((F.col("p_partkey") * 37 % 9000 + 1).alias("w"), (F.col("p_size") * 211 + 300).alias("h"))
    return reports.aspect_ratio(sizes, "w", "h").withColumn("median", F.round("median", 9))


@query(r"""
WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([a-zA-Z0-9]+)\s*/?>', 1), lambda x: lower(x)) AS a, list_transform(regexp_extract_all(replace(html, '<p>', '<br>'), '<([a-zA-Z0-9]+)\s*/?>', 1), lambda x: lower(x)) AS b FROM pages),
k AS (SELECT page_id, len(a) AS n, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS k FROM t)
SELECT page_id, round(CASE WHEN n > 0 THEN k / n END, 9) AS accuracy FROM k
""")
def tag_accuracies(spark, sf_dir):
    """Pages against themselves with every paragraph opener read as a line break."""
    guess = F.replace("html", F.lit("<p>"), F.lit("<br>"))
    return read(spark, sf_dir, "pages").select("page_id", F.round(tag_accuracy(F.col("html"), guess), 9).alias("accuracy"))


@query("SELECT doc_id, 4000 + 350 + ceil(length(text) / 4.0)::BIGINT AS tokens, 4000 + 350 + ceil(length(text) / 4.0)::BIGINT > 5000 AS too_long FROM documents")
def length_audit(spark, sf_dir):
    found = reports.length_audit(read(spark, sf_dir, "documents"), "text", F.lit(4000).cast("long"), 350, 5000)
    return found.select("doc_id", "tokens", "too_long")


@query("SELECT md5(text) AS page, count(*) AS n FROM documents GROUP BY page HAVING count(*) > 1")
def repeated_pages(spark, sf_dir):
    return reports.repeated_rows(read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("page")), "page")


def _marked_guess():
    marked = F.concat(F.lit("<i>"), F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("\n"), F.lit("</i>\n<pb/><i>")), F.lit("</i>"))
    return markup.stripped(marked)


_BARE = r"regexp_replace({}, '</?[a-zA-Z0-9]+[\x09-\x0D ]*/?>', '', 'g')"


@query(rf"""
WITH p AS (SELECT doc_id, {trimmed(_BARE.format("text"))} AS truth, {trimmed(_BARE.format("replace(text, 'th', 't')"))} AS guess FROM documents)
SELECT doc_id, round(CASE WHEN truth = '' THEN (guess <> '')::INT::DOUBLE ELSE {by_bytes("truth", "guess")} / length(truth) END, 9) AS cer FROM p
""")
def tag_stripped_cer(spark, sf_dir):
    """Every document, of any characters; tags of its own are stripped from both sides."""
    return read_dealt(spark, sf_dir, "documents").select("doc_id", F.round(cer(markup.stripped(F.col("text")), _marked_guess()), 9).alias("cer"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM (SELECT doc_id, replace(text, '<', '(') AS text FROM documents))
SELECT doc_id, line, 'i' AS closer, 'cs' AS open, '<i>' || t || '<cs>x</i></cs>' AS text FROM l WHERE length(t) % 2 = 0
""")
def crossed_report(spark, sf_dir):
    docs = read_dealt(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("<"), F.lit("(")))
    crossed = lambda t: F.when(F.length(t) % 2 == 0, F.concat(F.lit("<i>"), t, F.lit("<cs>x</i></cs>"))).otherwise(t)
    pages = docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), crossed), "\n").alias("page"))
    return reports.crossed_nesting(pages, "page", "doc_id")


_END = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


@query(rf"""
WITH l AS (SELECT doc_id, string_split(replace(text, '<', '('), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, len(ls) // 2 AS n, list_transform(ls, lambda x: regexp_replace(x, '{_END}', '')) AS rs FROM l),
t AS (SELECT doc_id, n, array_to_string(list_transform(range(1, n + 1), lambda k: CASE WHEN rs[2 * k - 1] <> '' THEN CASE WHEN k > 1 THEN chr(10) ELSE '' END || rs[2 * k - 1] || ' ' WHEN k > 1 THEN ' ' ELSE '' END || '<m_ref id="' || k || '"/>'), '')
|| CASE WHEN len(ls) % 2 = 1 AND rs[-1] <> '' THEN chr(10) || rs[-1] ELSE '' END AS main,
array_to_string(list_transform(range(1, n + 1), lambda k: '<m id="' || k || '">' || {trimmed("ls[2 * k]")} || '</m>'), chr(10) || chr(10)) AS notes, ls[1] AS alone FROM n)
SELECT doc_id, n AS anchors, true AS fit, md5(CASE WHEN n = 0 THEN alone ELSE main || chr(10) || chr(10) || '<marginalia>' || chr(10) || notes || chr(10) || '</marginalia>' END) AS page FROM t
""")
def anchored_marginalia(spark, sf_dir):
    """Every second line as a note of its own, then numbered: the proposed form with anchors and a section of notes."""
    lines = F.split(F.replace("text", F.lit("<"), F.lit("(")), "\n")
    page = F.array_join(F.transform(lines, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("<m>"), x, F.lit("</m>"))).otherwise(x)), "\n")
    docs = read_dealt(spark, sf_dir, "documents").select("doc_id", markup.with_anchors(page).alias("t"))
    return docs.select("doc_id", F.regexp_count("t", F.lit("<m_ref ")).cast("long").alias("anchors"), markup.anchors_fit(F.col("t")).alias("fit"), F.md5(F.col("t").cast("binary")).alias("page"))
