"""Names, model answers, markup and image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import geometry, markup, text
from quirefold.plans.registry import query, read, read_dealt


_UNSAFE = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\-]"


@query(rf"""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1'), '{_UNSAFE}', '_', 'g') AS stem,
left(regexp_replace(url, '{_UNSAFE}', '_', 'g'), 60) AS safe,
printf('%05d', page_id) || '_pages_' || regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1'), '{_UNSAFE}', '_', 'g') || '.jpg' AS name
FROM pages
""")
def safe_names(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    stem = text.safe_part(text.stem(F.col("url")))
    return pages.select("page_id", stem.alias("stem"), text.safe_part(F.col("url"), 60).alias("safe"), text.image_name(F.col("page_id"), "pages", F.col("url")).alias("name"))


@query(r"SELECT p_partkey, replace(left(p_name, 12), '-', '_') AS cut_first, left(regexp_replace(p_name, '[^0-9A-Za-z_]', '_', 'g'), 16) AS replace_first FROM part")
def short_tags(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.tag_cut_first(F.col("p_name")).alias("cut_first"), text.tag_replace_first(F.col("p_name")).alias("replace_first"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN printf('%05d', n_chars) ELSE doc_id::VARCHAR END AS number FROM documents")
def page_numbers(spark, sf_dir):
    facs = F.concat(F.lit("https://host/p/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").otherwise(".tif"), F.lit("/full"))
    return read(spark, sf_dir, "documents").select("doc_id", text.page_number(facs, F.col("n_chars")).alias("number"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def natural_order(spark, sf_dir):
    from quirefold.operators.sampling import numbered

    docs = read(spark, sf_dir, "documents").select("doc_id", text.natural_key(F.concat(F.lit("box_1/scan_"), F.col("doc_id").cast("string"), F.lit(".JPG"))).alias("k"))
    return numbered(docs, "k", start=1, name="place").select("doc_id", "place")


@query("SELECT s_suppkey, regexp_replace(regexp_replace(replace(s_name || ' (x)  1.pdf', ' ', '_'), '[^0-9A-Za-z_.\\-]', '', 'g'), '_+', '_', 'g') AS name FROM supplier".replace("\\\\", "\\"))
def ascii_file_names(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.ascii_names(F.concat(F.col("s_name"), F.lit(" (x)  1.pdf"))).alias("name"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def model_answers(spark, sf_dir):
    raw = F.concat(F.lit("<think>a\nb</think>junk<|im_start|>assistant"), F.lit("\n```markdown\n"), F.col("text"), F.lit("\n```\n "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.model_text(raw).alias("answer"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def unfenced_answers(spark, sf_dir):
    raw = F.concat(F.when(F.col("turn") % 2 == 0, " ```markdown\n").otherwise("```\n"), F.col("text"), F.lit("\n``` "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.unfenced(raw).alias("answer"))


@query("SELECT doc_id, left(text, 300) AS shown FROM documents")
def display_cut(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.display(F.col("text")).alias("shown"))


@query("SELECT doc_id, text FROM documents")
def unwrapped_tags(spark, sf_dir):
    marked = F.concat(F.lit("<ann1>"), F.replace("text", F.lit("\n"), F.lit("</ann2 />\n<ann3>")), F.lit("</ann4>"))
    return read_dealt(spark, sf_dir, "documents").select("doc_id", markup.unwrapped(marked).alias("text"))


_HALF = "string_split(replace(text, '. ', '.</m> '), chr(10))"


@query(rf"""
WITH l AS (SELECT doc_id, {_HALF} AS ls FROM documents),
b AS (SELECT doc_id, list_transform(ls, lambda x: repeat('<m>', ((length(x) - length(replace(x, '</m>', ''))) // 4)::INT) || x) AS ls FROM l)
SELECT doc_id, array_to_string(ls, chr(10)) AS text FROM b
""")
def line_balance(spark, sf_dir):
    half = F.replace("text", F.lit(". "), F.lit(".</m> "))
    return read_dealt(spark, sf_dir, "documents").select("doc_id", markup.line_balanced(half).alias("text"))


# Tags of a document's own would be markup: their brackets are turned.
_PLAIN = "replace(text, '<', '(')"
_TRIMMED = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _plain(spark, sf_dir):
    return read_dealt(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("<"), F.lit("(")).alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, string_split({_TRIMMED}, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '\S') THEN '<m>' || x || '</m>' ELSE '' END), chr(10)) AS t FROM l)
SELECT doc_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text, true AS converged FROM w
""")
def clean_markup(spark, sf_dir):
    """Every page as one note of many lines, with a note closer to balance: the clean form has one note a line."""
    squeezed = text.trim_u(F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    page = F.concat(F.lit("<m><m>"), squeezed, F.lit("</m><i> </i>"))
    return _plain(spark, sf_dir).select("doc_id", markup.cleaned(page).alias("c")).select("doc_id", "c.text", "c.converged")


def _each_line(spark, sf_dir, edit):
    lines = F.transform(F.split(text.trim_u(F.col("text")), "\n"), lambda x: F.coalesce(F.nullif(text.trim_u(x), F.lit("")), F.lit("-")))
    return _plain(spark, sf_dir).select("doc_id", F.array_join(F.transform(lines, edit), "\n").alias("page"))


_SOLID_LINES = rf"list_transform(string_split(regexp_replace({_PLAIN}, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: coalesce(nullif(regexp_replace(x, '^\s+|\s+$', '', 'g'), ''), '-'))"


@query(rf"""
WITH l AS (SELECT doc_id, {_SOLID_LINES} AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls, lambda x: '<i>a<cs>' || x || '</cs></i><cs>b</cs>'), chr(10)) AS text FROM l
""")
def uncrossed_tags(spark, sf_dir):
    """A pair that crosses another in every line."""
    pages = _each_line(spark, sf_dir, lambda x: F.concat(F.lit("<i>a<cs>"), x, F.lit("</i>b</cs>")))
    return pages.select("doc_id", markup.cleaned(F.col("page"))["text"].alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, {_SOLID_LINES} AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls, lambda x: '<i>' || x || ' <b>y</b></i>'), chr(10)) AS text FROM l
""")
def flattened_tags(spark, sf_dir):
    """Tags inside others of their name, two deep."""
    pages = _each_line(spark, sf_dir, lambda x: F.concat(F.lit("<i><i>"), x, F.lit("</i> <b>y</b></i>")))
    return pages.select("doc_id", markup.cleaned(F.col("page"))["text"].alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, {_SOLID_LINES} AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls, lambda x: x || '.'), chr(10)) AS text FROM l
""")
def blank_tags(spark, sf_dir):
    """Notes and pairs around nothing in every line."""
    pages = _each_line(spark, sf_dir, lambda x: F.concat(x, F.lit("<m> <i></i><b> <cs></cs></b></m><fn><i>  </i></fn>.")))
    return pages.select("doc_id", markup.cleaned(F.col("page"))["text"].alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, string_split({_PLAIN}, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) < 2 THEN ls[1] ELSE regexp_replace(array_to_string(list_filter(ls, lambda x, i: i % 2 = 1), chr(10)), '\s+$', '') END AS main_text,
coalesce(array_to_string(list_transform(list_filter(ls, lambda x, i: i % 2 = 0), lambda x: '<m>' || x || '</m>'), chr(10)), '') AS notes FROM l
""")
def marginalia_to_end(spark, sf_dir):
    """Every second line as a note: notes go to the end in order, one note each as main lines stand between them."""
    page = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("<m>"), x, F.lit("</m>"))).otherwise(x)), "\n")
    moved = _plain(spark, sf_dir).select("doc_id", markup.notes_last(page).alias("t"))
    at = F.locate("\n<m>", F.col("t"))
    return moved.select("doc_id", F.when(at > 0, F.substring("t", F.lit(1), at - 1)).otherwise(F.col("t")).alias("main_text"), F.when(at > 0, F.substring("t", at + 1, F.length("t"))).otherwise("").alias("notes"))


_SIZE = "(p_partkey * 37 % 9000 + 1)::BIGINT AS w, (p_size * 211 + 300)::BIGINT AS h"


def _sized(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 9000 + 1).cast("long").alias("w"), (F.col("p_size") * 211 + 300).cast("long").alias("h"))


@query(f"""
WITH s AS (SELECT p_partkey, {_SIZE} FROM part), f AS (SELECT p_partkey, CASE WHEN w * h > 5120000 THEN greatest(1, floor(w * sqrt(5120000.0::DOUBLE / (w * h))))::BIGINT ELSE w END AS w, CASE WHEN w * h > 5120000 THEN greatest(1, floor(h * sqrt(5120000.0::DOUBLE / (w * h))))::BIGINT ELSE h END AS h FROM s)
SELECT p_partkey, w, h, w * h // 1024 AS tokens FROM f
""")
def image_budget(spark, sf_dir):
    found = _sized(spark, sf_dir).select("p_partkey", geometry.fitted(F.col("w"), F.col("h")).alias("s")).select("p_partkey", "s.w", "s.h")
    return found.withColumn("tokens", geometry.visual_tokens(F.col("w"), F.col("h")))


@query(f"""
WITH s AS (SELECT p_partkey, {_SIZE} FROM part)
SELECT CASE WHEN p_partkey % 3 = 0 AND w * h // 2 <= 5120000 THEN 'kept' WHEN w * h > 5120000 THEN 'resized' ELSE 'copied' END AS action, count(*) AS n FROM s GROUP BY action
""")
def image_preparation(spark, sf_dir):
    kept = F.when(F.col("p_partkey") % 3 == 0, F.floor(F.col("w") * F.col("h") / 2))
    action = geometry.preparation(F.col("w"), F.col("h"), kept, F.lit(1))
    return _sized(spark, sf_dir).groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))
