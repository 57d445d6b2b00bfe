import difflib
import random
import re
import tracemalloc
import xml.etree.ElementTree as ET

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.functions import blocks, geometry, markup, metrics, text, xmltext


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<ann1>Brook</ann1> and <ann3/>mill", "Brook and mill"),
        ("<i>see <cs>Vol.</i></cs>", "<i>see <cs>Vol.</cs></i>"),
        ("<m><i>ibid.</m></i>", "<m><i>ibid.</i></m>"),
        ("gone</i> on", "gone</i> on"),
        ("<m>up\ndown</m>", "<m>up</m>\n<m>down</m>"),
        ("<m><i>up\ndown</i></m>", "<m><i>up</i></m>\n<m><i>down</i></m>"),
        ("<m> <i>up</i>\n<i>down</i> </m>", "<m> <i>up</i></m>\n<m><i>down</i> </m>"),
        ("<m><m>fol. 4</m>", "<m>fol. 4</m>"),
        ("<m>a<m>b</m></m>", "<m>ab</m>"),
        ("<b><b>k</b></b>", "<b>k</b>"),
        ("<i>vide</i></m>", "<m><i>vide</i></m>"),
        ("x <m>y", "x <m>y</m>"),
        ("<b>p <i>q <cs>r</b> s</cs></i>", "<b>p <i>q <cs>r</cs></i></b><i><cs> s</cs></i>"),
        ("<m><noodid></m>", "<m><noodid></m>"),
        ("1 < 2 <3> <x y> </i >", "1 < 2 <3> <x y> </i >"),
        ("a<m><i></i></m>b", "ab"),
        ("a <pb/> b <noodid> c", "a <pb/> b <noodid> c"),
        ("a  \n\n\n\nb", "a\n\nb"),
        ("", ""),
    ],
)
def test_clean_goldens(given, want):
    assert markup.clean(given) == (want, True)


def test_clean_invariants():
    rng, tags = random.Random(6), ["<m>", "</m>", "<i>", "</i>", "<cs>", "</cs>", "<b>", "</b>", "<pb/>", "<noodid>", "<ann2>", "</ann2>", "<fn>", "</fn>"]
    came_to_rest = 0
    for _ in range(1500):
        page = "".join(rng.choice([*tags, "a", "b ", " ", "\n", "word", "\n"]) for _ in range(rng.randint(0, 24)))
        got, converged = markup.clean(page)
        if not converged:
            continue
        came_to_rest += 1
        assert markup.clean(got) == (got, True)
        assert not any("\n" in m for m in re.findall(r"<m>(.*?)</m>", got, re.S))
        assert all(line.count("<m>") == line.count("</m>") for line in got.split("\n"))
        assert not re.search(r"<(\w+)>\s*</\1>", got)
        bare = lambda t: re.sub(r"\s", "", re.sub(r"</?[a-zA-Z0-9]+\s*/?>", "", t))
        assert bare(got) == bare(page)
    assert came_to_rest > 1400


def test_rounds_that_do_not_suffice_are_told(spark, monkeypatch):
    assert markup.clean("<m><i>ibid.</m></i>", rounds=0)[1] is False
    with pytest.raises(ValueError):
        monkeypatch.setattr(markup, "clean", lambda p: (p, False))
        markup._strict_series(pd.Series([None, "<i>a</i>"]))
    monkeypatch.undo()
    rows = spark.createDataFrame([("<m>a\nb</m>",), ("a \n\n\n\nb\u00a0",), (None,)], "t string")
    assert [r.x.text if r.x else None for r in rows.select(markup.cleaned(F.col("t"), strict=True).alias("x")).collect()] == ["<m>a</m>\n<m>b</m>", "a\n\nb", None]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("<m>x</m>", "x"), (" <cs><m>x</m></cs> ", "x"), ("<b><m>x</m></b>", "<b>x</b>"), ("<m><i>x</i></m>", "<i>x</i>"), ("<i><m><b>x</b></m></i>", "<i>x</i>"),
        ("<m>x</m> y <m>z</m>", "x</m> y <m>z"), ("<m></m>", ""), ("a <m>x</m>", None), ("<m>x</m> a", None), ("<m>x", None), ("", None), ("<m>x</i></m>", "x"),
    ],
)
def test_whole_notes(line, want):
    found = markup.whole_note(markup.read(line))
    assert (None if found is None else markup.write(found)) == want


def test_reading_and_writing_changes_nothing():
    rng = random.Random(8)
    for _ in range(300):
        page = "".join(rng.choice(["<m>", "</M >", "<", ">", "<pb/>", "a", "\n", "é ", "</", "<i  />"]) for _ in range(20))
        assert markup.write(markup.read(page)) == page and markup.write(markup.from_lines(markup.lines_of(markup.read(page)))) == page


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("main\n<m>x</m>\n<m>y</m>\nmain2", "main\nmain2\n<m>x\ny</m>"),
        ("a <m>n</m> b", "a b\n<m>n</m>"),
        ("left\n<m>l</m>\n<pb/>right\n<i><m>r</m></i>\nend", "left\n<m>l</m><pb/>right\nend\n<m><i>r</i></m>"),
        ("no notes", "no notes"),
        ("<m>A\nB</m>\nt", "t\n<m>A\nB</m>"),
    ],
)
def test_marginalia_goldens(given, want):
    assert markup.marginalia_last(given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a\n<m>x\ny</m>\nb <m>z</m> c", 'a <m_ref id="1"/>\nb <m_ref id="2"/> c\n\n<marginalia>\n<m id="1">x\ny</m>\n\n<m id="2">z</m>\n</marginalia>'),
        ("<m>x</m>\na", '<m_ref id="1"/>\na\n\n<marginalia>\n<m id="1">x</m>\n</marginalia>'),
        ("a\n<m>x</m>\n<m>y</m>", 'a <m_ref id="1"/> <m_ref id="2"/>\n\n<marginalia>\n<m id="1">x</m>\n\n<m id="2">y</m>\n</marginalia>'),
        ("none", "none"),
    ],
)
def test_anchors(spark, given, want):
    assert markup.anchored(given) == want
    assert one(spark, markup.anchors_fit(F.col("t")), t=want) is True
    assert want == "none" or one(spark, markup.anchors_fit(F.col("t")), t=want.replace('ref id="1"', 'ref id="7"')) is False


def test_markup_columns(spark):
    page = "x <i>a <cs>b</i></cs>\n<m>n</m>"
    df = spark.createDataFrame([(page,), (None,)], "t string")
    rows = df.select(markup.cleaned(F.col("t")).alias("c"), markup.notes_last(F.col("t")).alias("n"), markup.crossing_report(F.col("t")).alias("r"), markup.openers(F.col("t")).alias("o")).collect()
    assert rows[0].c.text == markup.clean(page)[0] and rows[0].n == markup.marginalia_last(page) and rows[0].o == ["i", "cs", "m"]
    assert [tuple(x) for x in rows[0].r] == [(1, "i", "cs", "x <i>a <cs>b</i></cs>")]
    assert rows[1].c.text is None and rows[1].n is None and rows[1].r is None


def test_line_balance_is_the_same_in_both_forms(spark):
    rng = random.Random(2)
    pages = ["".join(rng.choice(["<m>", "</m>", "a", "\n"]) for _ in range(20)) for _ in range(60)]
    rows = spark.createDataFrame([(p,) for p in pages], "t string").select("t", markup.line_balanced(F.col("t")).alias("x")).collect()
    assert all(r.x == markup.write(markup.even_lines(markup.read(r.t))) for r in rows)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for k in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 80))) for _ in range(2))
        if k % 2:
            b = a[: k // 8] + b[:5] + a[k // 8 + rng.randint(0, 3) :]
        assert metrics.edit_distance(a, b) == metrics.trimmed_distance(a, b) == metrics.trimmed_distance(list(a), list(b)) == plain_distance(a, b)


def test_bands_are_exact_within_their_width():
    rng = random.Random(8)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh"])
        a = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.8 else [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["z"]])
        a, b = sorted((a, b), key=len)
        want = plain_distance(a, b)
        for k in {len(b) - len(a), len(b) - len(a) + 1, want, want + 3}:
            found = metrics._banded(a, b, k)
            assert found == want if want <= k else found > k


@pytest.mark.parametrize("share", [0.01, 0.09, 0.15, 0.5, 1])
def test_long_texts_have_the_same_distance_by_bands(share):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    b = "".join(rng.choice(["", "x", c + "y"]) if rng.random() < share else c for c in a)
    assert metrics.trimmed_distance(a, b) == metrics.edit_distance(a, b) == metrics.trimmed_distance(b, a)


@pytest.mark.parametrize(("truth", "guess", "want"), [("", "", 0.0), ("", "a", 1.0), ("aſb", "ab", 1 / 3), ("ab", "abcd" * 3, 5.0), (" ab ", "ab", 0.0), ("é", "é", 1.0), ("x" * 2000, "x" * 1990 + "y" * 5, 10 / 2000)])
def test_cer(spark, truth, guess, want):
    assert one(spark, metrics.cer(F.col("a"), F.col("b")), a=truth, b=guess) == pytest.approx(want)


def test_wer_and_diagnostic(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("", "a"), (None, "a"), ("a b", "a b")], "a string, b string")
    assert [r.x for r in rows.select(metrics.wer(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 0.0, 1.0, None, 0.0]
    assert [r.x for r in rows.select(metrics.unmatched_share(F.col("a"), F.col("b")).alias("x")).collect()][:2] == [pytest.approx(1 - 4 / 7), 1.0]
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(2)) for _ in range(80)]
    want = [1 - sum(m.size for m in difflib.SequenceMatcher(None, guess, truth).get_matching_blocks()) / len(truth) for truth, guess in pairs]
    assert metrics._unmatched_series(*(pd.Series(x) for x in zip(*pairs, strict=True))).tolist() == pytest.approx(want)
    tags = spark.createDataFrame([("<i>a</i><i>b</i><pb/>", "<i>a</i> <pb/><b>c</b>"), ("a", "<i>")], "a string, b string")
    assert [r.x for r in tags.select(metrics.tag_accuracy(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(2 / 3), None]


@pytest.mark.parametrize(
    ("given", "want"),
    [("<think>x</think>assistant\nabc", "abc"), ("```text\nabc\n```", "abc"), ("a<|assistant|> b ", "b"), ("plain", "plain"), ("<think>\n</think>", "")],
)
def test_model_text(spark, given, want):
    assert one(spark, text.model_text(F.col("t")), t=given) == want


def test_names(spark):
    assert text.ascii_name("Žürii (ß)  _é_ nr.7.pdf_") == "Zurii_ss_e_nr.7.pdf" and text.ascii_name("中 -") == "-" and text.ascii_name("_ö _") == "o"
    assert one(spark, text.safe_part(F.col("t"), 5), t="ä b-c.d") == "ä_b-c"
    assert one(spark, text.stem(F.col("t")), t="a/b.c/scan.01.jpg") == "scan.01" and one(spark, text.stem(F.col("t")), t="a/.hidden") == ".hidden"
    assert one(spark, text.tag_cut_first(F.col("t")), t="kurrent-xix-data") == "kurrent_xix_" and one(spark, text.tag_replace_first(F.col("t")), t="a-b c.d" * 4) == ("a_b_c_d" * 4)[:16]
    assert one(spark, text.page_number(F.col("t"), F.col("n")), t="x/0012.tif", n=7) == "0012" and one(spark, text.page_number(F.col("t"), F.col("n")), t="x/12.png", n=7) == "00007"
    names = ["p10.jpg", "p9.jpg", "p1.jpg", "P2.jpg", "p001.jpg", "q.jpg", "p10a2.jpg", "p10a10.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").orderBy(text.natural_key(F.col("t")), "t").collect()
    natural = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n.lower())]
    assert [r.t for r in rows] == sorted(names, key=lambda n: (natural(n), n))


def test_lines(spark):
    rows = spark.createDataFrame([("a\n\n  \nb",), ("",), (None,), ("\n",)], "t string").select(text.n_lines(F.col("t")).alias("n"), text.has_text(F.col("t")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [(2, True), (0, False), (0, False), (0, False)]


def test_geometry(spark):
    size = one(spark, geometry.fitted(F.col("w"), F.col("h")), w=7155, h=8525)
    assert abs(size.w - 2072) <= 1 and abs(size.h - 2469) <= 1 and size.w * size.h <= geometry.BUDGET
    assert tuple(one(spark, geometry.fitted(F.col("w"), F.col("h")), w=100, h=100)) == (100, 100)
    assert one(spark, geometry.fitted(F.col("w"), F.col("h")), w=1, h=90_000_000).w == 1
    action = lambda kw, kh, w, h: one(spark, geometry.preparation(F.col("w"), F.col("h"), F.lit(kw).cast("long"), F.lit(kh).cast("long")), w=w, h=h)
    assert (action(10, 10, 9000, 9000), action(None, None, 9000, 9000), action(None, None, 10, 10), action(9000, 9000, 9000, 9000)) == ("kept", "resized", "copied", "resized")
    assert one(spark, geometry.visual_tokens(F.col("w"), F.col("h")), w=2048, h=2048) == 4096


NS = 'xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"'


def line(*units):
    return "<TextLine>" + "".join(f"<TextEquiv><Unicode>{u}</Unicode></TextEquiv>" for u in units) + "</TextLine>"


def region(name, *lines):
    return f'<TextRegion id="{name}">' + "".join(lines) + "</TextRegion>"


def order(*names):
    return "<ReadingOrder><OrderedGroup>" + "".join(f'<RegionRefIndexed index="9" regionRef="{n}"/>' for n in names) + "</OrderedGroup></ReadingOrder>"


PAGES = [
    (f"<PcGts {NS}><Page>{order('r2', 'r1')}{region('r1', line('a'))}{region('r2', line('b'))}{region('r3', line('c'))}</Page></PcGts>", "b\na\nc"),
    (f"<PcGts {NS}><Page>{order('r1', 'zz', 'r1')}{region('r1', line('a'))}</Page></PcGts>", "a\na"),
    (f"<PcGts {NS}><Page>{region('x', line('a'))}{region('y', line('b'))}{region('x', line('c'))}</Page></PcGts>", "c\nb"),
    (f"<PcGts {NS}><Page>{region('x', line('first', 'second'), line(' '), line(' t '))}</Page></PcGts>", "first\nt"),
    (f"<PcGts {NS}><Page>{region('x', line('1 &amp; 2'), line('007'), '<TextLine/>')}</Page></PcGts>", "1 & 2\n007"),
    ("<PcGts><Page>" + region("x", line("plain")) + "</Page></PcGts>", "plain"),
    (f"<p:PcGts {NS.replace('xmlns', 'xmlns:p')}><p:Page><p:TextRegion id='a'><p:TextLine><p:TextEquiv><p:Unicode>pre</p:Unicode></p:TextEquiv></p:TextLine></p:TextRegion></p:Page></p:PcGts>", "pre"),
    ("<a><b></a>", None),
    (f"<PcGts {NS}><Page></Page></PcGts>", None),
    (f"<PcGts {NS}><Other/></PcGts>", None),
    (f"<PcGts {NS}><Page>{order('b').replace(chr(34), chr(39))}{region('a', line('x'))}{region('b', line('y'))}</Page></PcGts>", "y\nx"),
    (f"<PcGts {NS}><Page><!-- {order('b')} -->{order('a')}<!-- <RegionRefIndexed regionRef='b'/> -->{region('b', line('y'))}{region('a', line('x'))}</Page></PcGts>", "x\ny"),
    (f"<PcGts {NS}><Page>{order('q&amp;r')}{region('b', line('y', '<![CDATA[<RegionRefIndexed regionRef=&quot;b&quot;/>]]>'))}{region('q&amp;r', line('x'))}</Page></PcGts>", "x\ny"),
    (f"<PcGts {NS}><Page><ReadingOrder><RegionRefIndexed note='a > b' regionRef = 'b' /></ReadingOrder>{region('a', line('x'))}{region('b', line('y'))}</Page></PcGts>", "y\nx"),
    # references count in Page's own ReadingOrder only
    (f"<PcGts {NS}><Metadata>{order('b')}</Metadata>{order('b')}<Page>{region('a', line('A') + order('b'))}{region('b', line('B'))}<Relations><RegionRefIndexed regionRef='b'/></Relations></Page></PcGts>", "A\nB"),
    (f"<PcGts {NS}><Page>{region('a', '<TextLine><TextEquiv><Unicode>x<i>y</i>z</Unicode></TextEquiv></TextLine>')}</Page></PcGts>", "x"),
    (f"<PcGts {NS}><Page>{region('a', '<TextLine><TextEquiv><PlainText>p</PlainText><Unicode>u</Unicode></TextEquiv></TextLine>')}</Page></PcGts>", "u"),
]


@pytest.mark.parametrize("many", [-1, 3])
def test_matching_blocks_equal_difflib(monkeypatch, many):
    monkeypatch.setattr(blocks, "MANY", many)
    rng = random.Random(3)
    for _ in range(2000):
        letters = rng.choice(["ab", "abc", "abcdefgh", "".join(map(chr, range(200, 500)))])
        n = rng.choice([0, 1, 5, 30, 150, 260, 400])
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        a = list(b) if rng.random() < 0.8 else [rng.choice(letters) for _ in range(rng.randint(0, n))]
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(a))
            a[at : at + rng.randint(0, 5)] = [rng.choice(letters)] * rng.randint(0, 2)
        a = "".join(a)
        assert blocks.matched(a, b) == sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_suffixes():
    found = blocks.Suffixes("abcbc|xabcx", frozenset("|"))
    assert found.longest("zzbcxabc") == (4, 6, 4) or found.longest("zzbcxabc")[2] == 4
    assert found.longest("bc") == (0, 1, 2) and found.longest("|") == (0, 0, 0) and found.longest("c|x")[2] == 1


def test_page_xml(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(PAGES)], "i int, x string").select("i", xmltext.page_xml(F.col("x")).alias("p")).orderBy("i").collect()
    for r, (_, want) in zip(rows, PAGES, strict=True):
        assert r.p.text == want, r.i
    assert [r.i for r in rows if r.p.malformed] == [7]
    assert one(spark, xmltext.page_xml(F.col("x"))["malformed"], x=None) is None


def test_alto_xml(spark):
    lines = "".join(f'<TextLine VPOS="{v}"><String CONTENT="{t}"/><String CONTENT=" "/><String CONTENT="{t}{t}"/></TextLine>' for v, t in ((30, "c"), (10.5, "a"), (20, "b")))
    xml = f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><TextBlock>{lines}</TextBlock><TextBlock><TextLine><String CONTENT="top"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    assert one(spark, xmltext.alto_xml(F.col("x")), x=xml) == "top\na aa\nb bb\nc cc"
    assert one(spark, xmltext.alto_xml(F.col("x")), x="<alto") is None
    deep = xml.replace("<TextBlock>", "<ComposedBlock><ComposedBlock><TextBlock>").replace("</TextBlock>", "</TextBlock></ComposedBlock></ComposedBlock>").replace("PrintSpace", "TopMargin")
    assert one(spark, xmltext.alto_xml(F.col("x")), x=deep) == "top\na aa\nb bb\nc cc"
    assert xmltext.alto_text('<alto><TextLine><String CONTENT="loose"/></TextLine></alto>') is None


def test_an_unreadable_place_counts_as_nought():
    lines = "".join(f'<TextLine VPOS="{v}"><String CONTENT="{v or "none"}"/></TextLine>' for v in ("7", "", "nan", "12px", "-1"))
    assert xmltext.alto_text(f"<alto><TextBlock>{lines}</TextBlock></alto>").split("\n") == ["-1", "none", "nan", "12px", "7"]


def plain_tei(xml, strict):
    """The pages by a tree: every element's text, following text and children as they come."""
    pages, lines = [], None
    body = next((e for e in ET.fromstring(xml).iter() if xmltext._local(e.tag) == "body"), None)

    def put(text):
        if lines is not None and (text or "").strip():
            lines[-1].append(text.strip())

    def walk(node):
        nonlocal lines
        name = xmltext._local(node.tag)
        if name == "pb" and node.get("facs"):
            lines = [[]]
            pages.append((node.get("facs"), node.get("type", ""), lines))
            return put(node.tail) if strict else None
        if name == "lb" and lines is not None:
            lines.append([])
        if name not in ("lb", "note"):
            put(node.text)
        if not strict:
            put(node.tail)
        if not (strict and name == "note"):
            for child in node:
                walk(child)
        if strict:
            put(node.tail)

    if body is not None:
        walk(body)
    return [(facs, kind, "\n".join(" ".join(x) for x in rows if x)) for facs, kind, rows in pages]


def test_tei_events_equal_a_tree(monkeypatch):
    rng = random.Random(4)

    def some(depth):
        out = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.choice(["text", "text", "pb", "lb", "odd", "node", "node"])
            if kind == "text":
                out.append(rng.choice(["x ", " y", "\n", "&amp;", "z<!-- c -->q", "<![CDATA[<k>]]>"]))
            elif kind == "node" and depth < 5:
                name = rng.choice(["p", "div", "note", "hi", "body", "lb"])
                out.append(f"<{name}>{some(depth + 1)}</{name}>")
            else:
                out.append({"pb": f'<pb facs="{rng.randint(1, 99)}" type="t"/>', "lb": "<lb/>", "odd": '<pb/><pb facs="7">in<hi>deep</hi></pb>'}.get(kind, ""))
        return "".join(out)

    for _ in range(1500):
        xml = f'<TEI xmlns="u">a<text>{some(4)}<body>{some(0)}</body>{some(4)}</text></TEI>'
        monkeypatch.setattr(xmltext, "FEED", rng.choice([1, 3, 50]))
        for strict in (False, True):
            assert sorted(xmltext.tei_pages(xml, strict)) == sorted(plain_tei(xml, strict)), xml


def test_a_long_tei_body_is_never_held_whole(monkeypatch):
    monkeypatch.setattr(xmltext, "FEED", 1 << 16)
    page = '<pb facs="{}.tif" type="t"/>' + "<p><lb/>" + "word " * 400 + "</p>"
    xml = "<TEI><text><body><div>" + "".join(page.format(i) for i in range(3000)) + "</div></body></text></TEI>"
    tracemalloc.start()
    try:
        n = sum(1 for _ in xmltext.tei_pages(xml))
        assert n == 3000 and tracemalloc.get_traced_memory()[1] < 2 << 20 < len(xml)
    finally:
        tracemalloc.stop()


def test_tei_table(spark):
    xml = '<TEI><text><body><pb facs="1"/>no<p>a</p><pb facs="2" type="k"/><p>b</p></body></text></TEI>'
    rows = xmltext.tei_table(spark.createDataFrame([(1, "k", xml), (2, None, "<bad"), (3, None, None)], "id long, facs_of string, x string"), "x", "id", "facs_of").collect()
    assert sorted(map(tuple, rows)) == [(1, "k", "1", "", "a"), (1, "k", "2", "k", "b")]


def test_tei_pages(spark):
    body = '<pb facs="1" type="t"/>gone<lb/>one <hi>foo <ex>bar</ex> baz</hi> qux<lb/>two<note>aside <hi>leak</hi></note> tail<pb/>x<pb facs="2"/><p>end</p>'
    xml = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>before{body}</body></text></TEI>'
    assert list(xmltext.tei_pages(xml)) == [("1", "t", "one foo qux bar baz\ntwo tail leak x"), ("2", "", "end")]
    assert list(xmltext.tei_pages(xml, strict_order=True))[0][2] == "gone\none foo bar baz qux\ntwo tail x"
    assert list(xmltext.tei_pages("<broken")) == [] and list(xmltext.tei_pages("<TEI/>")) == []
    spark.udtf.register("tei_pages_test", xmltext.tei_function())
    spark.createDataFrame([(xml,), (None,)], "x string").createOrReplaceTempView("tei_test")
    assert spark.sql("select p.* from tei_test, lateral tei_pages_test(x) p").count() == 2


def test_matching_blocks_of_long_prose_are_found_in_one_pass(monkeypatch):
    random.seed(7)
    words = ["the", "anther", "on", "Qu", "zix", "re-", "vex", "hand,", "jot.", "a"]
    truth = " ".join(random.choices(words, k=1500))
    cases = [(truth.replace("th", "t").replace("an", "en"), truth), (truth[4000:] + truth[:4000], truth), (truth[:300], truth[200:]), (truth[::-1], truth), (truth, truth)]
    want = [sum(block.size for block in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in cases]

    def never(*_, **__):
        raise AssertionError("searched again for every block")

    monkeypatch.setattr(blocks.difflib, "SequenceMatcher", never)
    monkeypatch.setattr(blocks, "Suffixes", never)
    assert [blocks.matched(a, b) for a, b in cases] == want


def test_distance_of_prose_is_proven_by_pieces(monkeypatch):
    random.seed(11)
    truth = " ".join("".join(random.choices(["th", "an", "er", "on", "st", "e", "ly", "re", "ti", "ou", "in", "nd", "wh", "ble", "es", "ha"], k=random.randint(1, 4))) for _ in range(900))
    pairs = [(truth, truth.replace("th", "t").replace("an", "en")), (truth[:500] + "Qx" + truth[500:], truth), (truth, truth[:700] + truth[703:] + "!")]
    want = [metrics.edit_distance(a, b) for a, b in pairs]

    def never(*_):
        raise AssertionError("compared in full")

    monkeypatch.setattr(metrics, "edit_distance", never)
    monkeypatch.setattr(metrics, "_banded", never)
    assert [metrics.trimmed_distance(a, b) for a, b in pairs] == want
    assert [metrics.trimmed_distance(b, a) for a, b in pairs] == want


@pytest.mark.parametrize("letters", ["ab", "abc ", "abcdefgh", "abcdefghijklmnopqrstuvwxyz  "])
def test_proven_distances_equal_the_plain_ones(letters):
    random.seed(13)
    for n in [64, 65, 90, 200, 400] * 12:
        a, often = "".join(random.choices(letters, k=n)), random.choice([0.01, 0.05, 0.2])
        b = "".join(c if random.random() > often else random.choice(["", random.choice(letters), c + random.choice(letters), "\n" * 20]) for c in a)
        b = random.choice([b, b, b[30:] + b[:30], b[:20] + b[50:], "".join(random.choices(letters, k=n))])
        want = metrics.edit_distance(a, b)
        assert metrics.trimmed_distance(a, b) == metrics.trimmed_distance(b, a) == want
        groups = metrics._some_edits(a, b)
        taken = sum(edits for _, _, edits in groups)
        assert taken >= want and (taken == want or not metrics._needed(a, b, groups))
