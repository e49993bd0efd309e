"""Readers of marked-up sources and the operators on citations and readings, on small rows."""

import datetime

from pyspark.sql import functions as F

from folium.operators import citing
from folium.sources import markup


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tei_lines(spark):
    xml = """<text><lb n="0001a01" ed="T"/>one <note>aside</note>two<lb n="x" ed="B"/>
<lb n="0001a02" ed="T"/><lg>verse <app><lem wit="A">kept</lem><rdg wit="B C">lost</rdg></app></lg><lb n="0001a03" ed="T"/><g ref="CB001"/></text>"""
    got = markup.tei_lines(frame(spark, [("a", xml), ("b", None)], "path string, text string")).orderBy("ordinal").collect()
    assert [(r["locator"], r["kind"], r["content"], r["notes"]) for r in got] == [("0001a01", "p", "one two", "aside"), ("0001a02", "verse", "verse kept", ""), ("0001a03", "p", "CB001", "")]
    assert got[0]["foreign_lines"] == 1
    variants = markup.apparatus_variants(markup.tei_lines(frame(spark, [("a", xml)], "path string, text string"))).collect()
    assert {(r["lem"], r["reading"], r["witness"]) for r in variants} == {("kept", "lost", "B"), ("kept", "lost", "C")}


def test_page_stream_carries_works_across_volumes(spark):
    lines = [(1, 0, '<milestone unit="text" toh="1"/>'), (1, 1, '<page n="1a"/><line n="1"/>ka'), (2, 0, '<page n="1b"/><line n="1"/>kha'), (2, 1, '<milestone unit="text" toh="2"/>ga')]
    got = markup.page_stream(frame(spark, lines, "volume int, line_no int, value string"))
    assert [(r["work"], r["page"], r["text"]) for r in got.orderBy("volume", "line_no").collect()] == [("1", "1a", "ka"), ("1", "1b", "kha"), ("2", "1b", "ga")]
    assert {r["work"]: (r["volumes"], r["contiguous"]) for r in markup.volumes_assembled(got).collect()} == {"1": (2, True), "2": (1, True)}


def test_authority_and_dictionaries(spark):
    xml = """<person xml:id="A1"><persName>Kumara</persName><birth when="0344-01-01"/><death when="0413-13-01"/><note type="dynasty">Jin</note></person><person xml:id="A2"></person>"""
    got = {r["id"]: r for r in markup.people(frame(spark, [("f", xml)], "path string, text string")).collect()}
    assert got["A1"]["born"] == datetime.date(344, 1, 1) and got["A1"]["died"] is None and got["A2"]["name"] is None
    xml = """<place xml:id="P1"><placeName>X</placeName><geo>108.9 34.3</geo><district>China/Shaanxi</district></place><place xml:id="P2"><geo>500 34</geo></place>"""
    got = {r["id"]: r for r in markup.places(frame(spark, [("f", xml)], "path string, text string")).collect()}
    assert (got["P1"]["lon"], got["P1"]["lat"], got["P1"]["district"]) == (108.9, 34.3, ["China", "Shaanxi"]) and got["P2"]["lon"] is None
    xml = "".join(f'<entry xml:id="e{i}"><orth>{w}</orth><sense>s{i}</sense></entry>' for i, w in enumerate("aba"))
    assert {(r["headword"], r["n"], r["sense"]) for r in markup.dictionary(frame(spark, [("f", xml)], "path string, text string")).collect()} == {("a", 1, "s0"), ("b", 1, "s1"), ("a", 2, "s2")}
    j = '{"sequences": [{"canvases": [{"label": "1a", "images": [{"resource": {"@id": "http://x/y/I1.jpg"}}]}]}]}'
    assert [tuple(r) for r in markup.canvases(frame(spark, [(1, j)], "volume int, json string")).collect()] == [(1, "1a", "I1.jpg")]
    u = [("# c",), ("U+4E2D\tkMandarin\tzhōng",), ("U+4E2D\tkHanyuPinyin\t10.1:zhòng,zhōng",), ("U+4E2D\tkOther\tx",)]
    assert [tuple(r) for r in markup.unihan(frame(spark, u, "value string"), ("kMandarin", "kHanyuPinyin")).collect()] == [("中", ["zhòng", "zhōng"])]
    c = markup.cedict(frame(spark, [("# c",), ("中國 中国 [Zhong1 guo2] /China/Middle Kingdom/",)], "value string")).collect()
    assert [(r["traditional"], r["reading"], r["senses"]) for r in c] == [("中國", "zhong1 guo2", ["China", "Middle Kingdom"])]
    w = markup.work_list(frame(spark, [("T/T10n0262.xml",), ("T/T09n0262.xml",), ("readme",)], "path string")).collect()
    assert [(r["canon"], r["work"], r["volumes"], r["paths"]) for r in w] == [("T", "T0262", [9, 10], ["T/T09n0262.xml", "T/T10n0262.xml"])]
    heads = frame(spark, [("f", 1, 1, "Title 12"), ("f", 1, 2, "Title 13"), ("f", 2, 1, "Title and more")], "file string, page int, line_no int, value string")
    assert {r["value"] for r in markup.running_head_stripped(heads, F.lit("Title")).collect()} == {"Title 13", "Title and more"}


def test_foreign_citations_and_addresses(spark):
    texts = frame(spark, [(1, "see T0262_.09.0001c19 and T. 262, 6a23; mn1:1.1 says"), (2, None), (3, "T262 6a23 · T.262:27b-1 · T0262.0006a23"), (4, "pli-tv-bu-vb-pj1:2.3 sn22.51:1.1 but T 262 or MN 10 alone")], "doc_id int, text string")
    got = [(r["form"], r["work"], r["volume"], r["page"], r["register"], r["line"], r["from_foot"], r["segment"]) for r in citing.foreign_citations(texts).orderBy("doc_id", "start").collect()]
    assert got == [
        ("sat", "T0262", 9, 1, "c", 19, False, None), ("print", "T0262", None, 6, "a", 23, False, None), ("sutta", "mn1", None, None, None, None, False, "1.1"),
        ("print", "T0262", None, 6, "a", 23, False, None), ("print", "T0262", None, 27, "b", 1, True, None), ("sat", "T0262", None, 6, "a", 23, False, None),
        ("sutta", "pli-tv-bu-vb-pj1", None, None, None, None, False, "2.3"), ("sutta", "sn22.51", None, None, None, None, False, "1.1"),
    ]
    lines = frame(spark, [(f"u{n}", 9, 1, "a", n) for n in range(1, 30)] + [("other", 9, 1, "a", 7)], "urn string, volume int, page int, register string, line int")
    asked = frame(spark, [(1, 9, 1, "a", 3, False), (2, 9, 1, "a", 2, True), (3, 9, 1, "a", 7, False), (4, 9, 2, "a", 1, False)], "id int, volume int, page int, register string, line int, from_foot boolean")
    assert {r["id"]: (r["urn"], r["problem"]) for r in citing.address_to_urn(asked, lines).collect()} == {1: ("u3", None), 2: ("u28", None), 3: (None, "ambiguous"), 4: (None, "not_found")}


def test_foreign_citations_are_read_by_their_parts():
    cases = {
        "T. 9, 1a1": [("print", "T0009", 1, "a", False, 1)], "T262.3b12": [("print", "T0262", 3, "b", False, 12)], "T 262 , 6a-23.": [("print", "T0262", 6, "a", True, 23)],
        "T262 6a234": [], "T262 6d2": [], "T26234 6a2": [], "AT262 6a2": [], "T_262 6a2": [], "T262 1234a5": [], "T262,6a": [],
        "T0262.09.0006a23": [("sat", "T0262", 6, "a", False, 23)], "T0262_09.0006a23": [], "T0262.0006a2": [], "T0262.0006a233": [], "T0262.09.006a23": [], "T026.0006a23": [],
        "t262 6a2": [], "(T262 6a2)": [("print", "T0262", 6, "a", False, 2)],
    }
    for text, want in cases.items():
        assert [(c["form"], c["work"], c["page"], c["register"], c["from_foot"], c["line"]) for c in citing.citations_in(text)] == want, text
    suttas = {"sn22.51:1.1": ("sn22.51", "1.1"), "see an1.1-10:2.3.4, and": ("an1.1-10", "2.3.4"), "mn1:1.2.3x": ("mn1", "1.2"), "MN1:1.1": None, "mn:1.1": None, "mn1:1": None, "mn.1:1.1": None, "x_mn1:1.1": None, "12:30.5": None}
    for text, want in suttas.items():
        assert [(c["work"], c["segment"]) for c in citing.citations_in(text)] == ([want] if want else []), text
    assert citing.citations_in("") == []


def test_rewriting_and_quotes(spark):
    r = frame(spark, [('T1 and "T1" or T1', "T1", "urn")], "t string, f string, u string").select(citing.rewritten(F.col("t"), F.col("f"), F.col("u")).alias("x")).first()
    assert r["x"] == 'urn and "T1" or urn'
    marks = frame(spark, [("T1「T1」T1『T1』“T1” T1 “T1", "T1", "u")], "t string, f string, u string").select(citing.rewritten(F.col("t"), F.col("f"), F.col("u")).alias("x")).first()
    assert marks["x"] == "u「T1」u『T1』“T1” u “u"
    q = frame(spark, [("b", "abc"), ("b", "abcb"), ("z", "abc"), ("", "abc")], "q string, s string").select(citing.quote_in_source(F.col("q"), F.col("s")).alias("at")).collect()
    assert [x["at"] for x in q] == [1, None, None, None]


def test_parallels_and_genres(spark):
    got = [x["v"] for x in frame(spark, [("S iii 12-15",), ("M xiv 7",), ("nothing",)], "a string").select(citing.volpage(F.col("a")).alias("v")).collect()]
    assert [tuple(x) if x else None for x in got] == [(3, 12, 15), (14, 7, 7), None]
    flat = citing.flatten_parallels(frame(spark, [("a", {"full": ["b", "~c", "b"]})], "uid string, parallels map<string,array<string>>")).collect()
    assert {(r["a"], r["b"], r["partial"]) for r in flat} == {("a", "b", False), ("a", "c", True)}
    titles = frame(spark, [("མདོ",), ("མདོ་འགྲེལ་པ།",), ("མདོ་འགྲེལ་བཤད",)], "title string")
    assert {(r["title"], r["explains"]) for r in citing.genre_relations(titles).collect()} == {("མདོ་འགྲེལ་པ།", "མདོ"), ("མདོ་འགྲེལ་བཤད", "མདོ་འགྲེལ་པ།")}


def test_chains_of_commentaries(spark):
    root, rgyan, vrtti = "ཚད་མ་རྣམ་འགྲེལ་གྱི་ཚིག་ལེའུར་བྱས་པ", "ཚད་མ་རྣམ་འགྲེལ་གྱི་རྒྱན", "ཚད་མ་རྣམ་འགྲེལ་གྱི་འགྲེལ་པ"
    chain = [(4210, root), (4216, vrtti), (4217, vrtti), (4221, rgyan), (4222, f"{rgyan}་གྱི་འགྲེལ་བཤད"), (4224, "ཚད་མ་རྣམ་འགྲེལ་གྱི་འགྲེལ་བཤད་ཅེས་བྱ་བ"), (9, "ལྷ"), (10, "ལྷ་ཆོ་ག་འགྲེལ་པ"), (11, "ལྷའི་བཤད་པ"), (12, None)]
    got = {(r["work"], r["parent"], r["relation"], r["confidence"]) for r in citing.genre_relations(frame(spark, chain, "work int, title string")).collect()}
    # the verses, by their family; the ornament, by its title; both works of the nearer layer; a title; nothing for a ritual
    assert got == {
        (4216, 4210, "comments_on", "probable"), (4217, 4210, "comments_on", "probable"), (4222, 4221, "comments_on", "probable"),
        (4224, 4216, "subcommentary_of", "uncertain"), (4224, 4217, "subcommentary_of", "uncertain"), (11, 9, "comments_on", "probable"),
    }


def test_pinyin(spark):
    assert [citing.pinyin_mark(s) for s in ("zhong1", "lv3", "gui4", "dou4", "ma5", "er", "ren2")] == ["zhōng", "lǚ", "guì", "dòu", "ma", "er", "rén"]
    r = frame(spark, [("zhong1 guo2",), (None,)], "p string").select(citing.toned(F.col("p")).alias("t"), citing.toneless(citing.toned(F.col("p"))).alias("b")).collect()
    assert [(x["t"], x["b"]) for x in r] == [("zhōng guó", "zhong guo"), (None, None)]


def test_cursor_alignment_and_coverage(spark):
    passages = frame(spark, [("w", i, t) for i, t in enumerate(["aa", "??", "cc", "zz"])], "work string, n long, text string")
    got = citing.cursor_alignment(passages, frame(spark, [("w", "aa bb cc")], "work string, text string")).orderBy("n").collect()
    assert [(r["start"], r["how"]) for r in got] == [(0, "exact"), (3, "interpolated"), (6, "exact"), (-1, "none")]
    chunks = frame(spark, [(1, 0, 0, 3), (1, 1, 4, 9)], "text_id int, chunk_no int, first_ordinal long, last_ordinal long")
    r = frame(spark, [(1, 2, 4, 1, "second"), (1, 0, 1, 0, "first")], "text_id int, first long, last long, reading_order int, text string")
    assert [tuple(x) for x in citing.covered_renderings(r, chunks).collect()] == [(1, 0, "first second")]
