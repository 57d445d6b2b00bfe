"""Sources and documents: CSV round trips, ranges, PAGE, ALTO and TEI."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirefold.functions import xmltext
from quirefold.operators import provenance
from quirefold.plans.registry import query, read, read_dealt
from quirefold.session import shared_folder
from quirefold.sources import archive, sinks, tables
from quirefold.tables import own_folder, written


@query("SELECT 'images/' || doc_id || '.jpg' AS failinimi, text AS transkriptsioon, source AS allikas FROM documents")
def csv_round_trip(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("images/"), F.col("doc_id"), F.lit(".jpg")).alias("failinimi"), F.col("text").alias("transkriptsioon"), F.col("source").alias("allikas"))
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.write_corpus(rows, path)
    return tables.read_corpus(spark, path)


@query("SELECT 'scans/' || doc_id || '.jpg' AS image FROM documents")
def relocated_paths(spark, sf_dir):
    path = F.concat(F.lit("/srv/data/images/"), F.col("doc_id"), F.lit(".jpg"))
    return read(spark, sf_dir, "documents").select(tables.relocated(path, "scans").alias("image"))


@query("SELECT printf('%05d', i) AS page FROM (SELECT min(page_id) AS low, max(page_id) AS high FROM pages), LATERAL unnest(range(low, high + 1)) t(i)")
def number_range(spark, sf_dir):
    """The numbers between the first page's and the last one's."""
    low, high = read(spark, sf_dir, "pages").agg(F.min("page_id"), F.max("page_id")).first()
    found = tables.number_range(spark, f"{low or 0:05d}..{high or 0:05d}")
    return found if low is not None else found.limit(0)


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def pruned_scan(spark, sf_dir):
    return tables.read_rows(spark, f"{sf_dir}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _escaped(column):
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


# What XML can't hold becomes a blank.
_NO_CONTROLS = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F]', ' ', 'g')"
_LINES = rf"list_filter(list_transform(string_split({_NO_CONTROLS}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _printable(spark, sf_dir):
    return read_dealt(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " "))


@query(f"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents)
SELECT doc_id, nullif(array_to_string(list_concat(list_filter(ls, lambda x, i: i % 2 = 0), list_filter(ls, lambda x, i: i % 2 = 1)), chr(10)), '') AS text, false AS malformed FROM l
""")
def page_xml_text(spark, sf_dir):
    """Odd lines in region a, even ones in region b; the reading order puts b first and leaves a out."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def region(name, odd):
        kept = F.filter(F.transform(lines, lambda x, i: F.when(i % 2 == (0 if odd else 1), x)), lambda x: x.isNotNull())
        body = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("<TextLine><TextEquiv><Unicode> "), _escaped(x), F.lit("</Unicode></TextEquiv><TextEquiv><Unicode>no</Unicode></TextEquiv></TextLine>"))), "")
        return F.concat(F.lit(f'<TextRegion id="{name}">'), body, F.lit("</TextRegion>"))

    order = F.lit('<ReadingOrder><OrderedGroup id="g"><RegionRefIndexed index="0" regionRef=\'b\'/><!-- <RegionRefIndexed regionRef="a"/> --><RegionRefIndexed index="1" regionRef="zz"/></OrderedGroup></ReadingOrder>')
    head = F.lit('<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="x.jpg">')
    xml = F.concat(head, order, region("a", True), region("b", False), F.lit("</Page></PcGts>"))
    return _printable(spark, sf_dir).select("doc_id", xmltext.page_xml(xml).alias("p")).select("doc_id", "p.text", "p.malformed")


@query(f"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents)
SELECT doc_id, nullif(array_to_string(list_reverse(ls), chr(10)), '') AS text FROM l
""")
def alto_xml_text(spark, sf_dir):
    """Lines whose vertical place falls: the text comes back bottom up."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    quoted = lambda x: F.replace(_escaped(x), F.lit('"'), F.lit("&quot;"))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit('<TextLine VPOS="'), (F.lit(100000) - i).cast("string"), F.lit('"><String CONTENT="'), quoted(x), F.lit('"/></TextLine>'))), "")
    xml = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><ComposedBlock><ComposedBlock><TextBlock>'), body, F.lit("</TextBlock></ComposedBlock></ComposedBlock></PrintSpace></Page></Layout></alto>"))
    return _printable(spark, sf_dir).select("doc_id", xmltext.alto_xml(xml).alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents)
SELECT doc_id, k || '.tif' AS facs, CASE k WHEN 1 THEN 'diaryEntry' ELSE 'cover' END AS kind, CASE k WHEN 1 THEN array_to_string(ls, chr(10)) ELSE 'end' END AS text FROM l, (VALUES (1), (2)) v(k)
""")
def tei_page_text(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<lb/>"), _escaped(x), F.lit("<note>aside</note>"))), "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><pb facs="1.tif" type="diaryEntry"/>'), body, F.lit('<pb facs="2.tif" type="cover"/><p>end</p></body></text></TEI>'))
    return xmltext.tei_table(_printable(spark, sf_dir).select("doc_id", xml.alias("xml")), "xml", "doc_id")


@query("SELECT doc_id, '1.tif' AS facs FROM documents")
def diary_pages(spark, sf_dir):
    """Of the pages above those of one kind."""
    return provenance.of_kind(tei_page_text(spark, sf_dir)).select("doc_id", "facs")


@query("""
SELECT source, count(*) AS members, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT doc_id) AS stems FROM documents WHERE doc_id % 3 <> 0 GROUP BY source
""")
def archive_members(spark, sf_dir):
    """Documents packed into archives, plain and compressed, a text or a note each, and read back by the archives' index: texts
    only, with the suffix in either case. A member's folder is its source; texts that are null lie in a folder `none` below it."""
    n = F.col("doc_id")
    suffix = F.when(n % 3 == 0, "md").when(n % 2 == 0, "xml").when(n.isNotNull(), "XML").otherwise("md")
    # a source as a folder: without slashes, and a percent sign alone where there is none
    folder = F.coalesce(F.url_encode("source"), F.lit("%"))
    name = F.concat(folder, F.when(F.col("text").isNull(), "/none/").otherwise("/"), F.coalesce(n.cast("string"), F.lit("-")), F.lit("."), suffix)
    docs = read(spark, sf_dir, "documents").repartition("doc_id").select(name.alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    packed = written(archive.pack(docs, f"{own_folder(spark)}/archives-{uuid.uuid4().hex}"), "archives")
    found = written(archive.index(archive.each_alone(packed)).where(archive.with_suffix(".xml")), "archive-index")
    texts = archive.contents(found, 16 << 20)
    parts = F.split("member", "/")
    source = F.when(parts[0] != "%", F.url_decode(F.when(parts[0] != "%", parts[0])))
    size = F.when(F.size(parts) == 2, F.octet_length("content"))
    return texts.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("members"), F.sum(size).cast("long").alias("bytes"), F.count_distinct("stem").alias("stems"))
