"""The research questions, one search in its modes, and the intake's stages, on a small corpus."""

import pytest

from folium.operators import commentary, evidence, finding, glossary, lexical, vectors
from folium.sources import stages
from folium.tools import Research


@pytest.fixture(scope="module")
def research(spark, tmp_path_factory):
    docs = [(1, "the river and the sea\nwhat is a river? a river is water\nend", "en", "a"), (2, "the mountain\nand the river", "en", "b"), (3, "der Berg und der See", "de", "a")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    finding.write_corpus(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), folder)
    near = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 0, [0.0, 1.0])], "doc_id long, chunk_no int, embedding array<float>")
    t = spark.createDataFrame
    return Research(
        finding.read_corpus(spark, folder, near),
        works=t([("w1", "Root", "p1"), ("w2", "Notes", "p2")], "work string, title string, person string"),
        relations=t([("w2", "w1", None, "comments_on", "m", 1), ("w1", "w3", None, "parallel_to", "m", 1)], "source string, target string, ref string, relation string, method string, at long"),
        alignments=t([("w1", 2, 5, "g1", 4, True, "w2"), ("w1", 3, 3, "g2", 9, False, "w2")], "work string, first long, last long, gloss string, length long, reviewed boolean, commentary string"),
        renderings=t([("w1", 1, "h1", "en", "a stream"), ("w1", 1, "h2", "en", "a river, a river"), ("w1", 2, "h1", "en", "x")], "work string, ordinal long, translator string, lang string, text string"),
        people=t([("p2", "Second", "p1"), ("p1", "First", None)], "person string, name string, teacher string"),
        witnesses=t([("w1", "A", 1, "x"), ("w1", "B", 1, "y"), ("w1", "A", 2, "z"), ("w1", "B", 2, "z")], "work string, witness string, ordinal long, text string"),
        quotations=t([(1, 10, 2, 40, 20)], "a_doc long, a_start long, b_doc long, b_start long, length long"),
        readings={"ab": "AB", "a": "A"},
        entries=t([("River", "stream", False, True), ("river", "flood", True, True)], "term string, rendering string, rejected boolean, verified boolean"),
    )


def test_one_search_in_its_modes(spark, research):
    places = lambda rows, *c: [tuple(r[x] for x in c) for r in rows.orderBy("rank").collect()]
    assert places(research.search("a river", "phrase"), "doc_id", "ordinal") == [(1, 1)]
    assert places(research.search("river", "auto", lexical.Scope(sources=("b",))), "doc_id", "ordinal") == [(2, 1)]
    assert {r[0] for r in places(research.search("river mountain", "terms"), "doc_id")} == {1, 2}
    wanted = spark.createDataFrame([(0, [0.8, 0.6])], "query_id int, embedding array<float>")
    assert places(research.search("river", "semantic", limit=2, wanted=wanted), "doc_id") == [(2,), (1,)]
    hybrid = places(research.search("mountain", "anything else", limit=3, wanted=wanted), "doc_id")
    assert hybrid[0] == (2,) and len(hybrid) == 3
    german = research.search("Berg", "hybrid", lexical.Scope(langs=("de",)), wanted=wanted)
    assert places(german, "doc_id") == [(3,)]
    with pytest.raises(ValueError):
        research.search("river", "hybrid")
    with pytest.raises(ValueError):
        research.search("river", "phrase", limit=0)


def test_passages_and_surveys(research):
    assert research.get_passage(1, 1, 1).first()["text"] == "what is a river? a river is water"
    assert research.get_passage(1, 1, 1, around=1).first()["text"].startswith("the river and the sea\n")
    assert {r["value"]: r["segments"] for r in research.survey_corpus("river").where("axis = 'source'").collect()} == {"a": 2, "b": 1}
    assert research.get_outline(1).count() == 1
    assert [r["ordinal"] for r in research.define_from_canon("river", ("is water",)).collect()] == [1]


def test_relations_and_glosses(spark, research):
    assert [r["source"] for r in research.get_commentaries("w1").collect()] == ["w2"]
    assert [r["work"] for r in research.get_parallels("w1").collect()] == ["w3"]
    assert [(r["gloss"], r["to_review"]) for r in research.get_glosses("w1", 3).orderBy("place").collect()] == [("g2", True), ("g1", False)]
    divisions = spark.createDataFrame([("w1", "first", 0, 3), ("w1", "second", 4, 9)], "work string, division string, lo long, hi long")
    assert {r["division"]: (r["glosses"], r["lines"]) for r in research.get_commentary_outline("w1", divisions).collect()} == {"first": (2, 2), "second": (1, 2)}
    assert [r["person"] for r in research.get_person("p2").orderBy("hop").collect()] == ["p2", "p1"]
    assert [r["node"] for r in research.resolve_root(spark.createDataFrame([("w2",)], "start string")).orderBy("hop").collect()] == ["w2", "w1"]
    assert research.get_works_by_person("p1").count() == 1


def test_versions_and_words(spark, research):
    assert {r["translator"]: r["lines"] for r in research.compare_translators("w1").collect()} == {"h1": 2, "h2": 1}
    assert {(r["kind"], r["other"]) for r in research.compare_versions("w1").collect()} == {("rendering", "h1"), ("rendering", "h2"), ("parallel", "w3"), ("alternate", "A"), ("alternate", "B")}
    assert {r["ordinal"]: r["agree"] for r in research.compare_witnesses("w1").collect()} == {1: False, 2: True}
    assert [(r["translator"], r["occurrences"]) for r in research.search_translations("a river").collect()] == [("h2", 2)]
    assert research.get_quotations(2, 50, 55).first()["other"] == 1 and research.get_quotations(2, 60, 65).count() == 0
    assert research.get_readings(spark.createDataFrame([(1, "aba")], "doc_id long, text string")).first()["reading"] == "ABA"
    assert [(r["rendering"], r["status"]) for r in research.look_up(spark.createDataFrame([("RIVER",)], "term string")).collect()] == [("stream", "preferred")]


def test_reports(spark, research):
    text = 'It says "the river and" (a:1@l0), “nothing” a:1@l2 and a:1@l9 or [a:1@l1'
    status = research.verify_report(spark.createDataFrame([(7, text)], "report_id long, text string")).first()
    assert (status["checked"], status["failed"], status["existence_only"], status["status"]) == (4, 2, 1, "failed")
    found = evidence.occurrences(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("byte_start").collect()
    assert [(r["urn"], r["quoted"], r["wrapped"], r["unpaired"]) for r in found] == [("a:1@l0", "the river and", True, False), ("a:1@l2", "nothing", False, False), ("a:1@l9", None, False, False), ("a:1@l1", None, False, True)]
    assert all(text.encode()[r["byte_start"] : r["byte_end"]].decode() == r["urn"] for r in found)


def test_vectors_states_and_scopes(spark):
    rows = spark.createDataFrame([(1, "source", "en", None, "x"), (2, "translation", "de", "h", "y"), (3, "translation", "en", "k", "z")], "chunk long, kind string, lang string, translator string, sha256 string")
    wanted = spark.createDataFrame([(1, "source", "en", None, "x"), (2, "translation", "de", "h", "new"), (4, "source", "en", None, "w")], rows.schema)
    assert {r["chunk"]: r["state"] for r in vectors.state(rows, wanted).collect()} == {1: "current", 2: "stale", 3: "orphan", 4: "missing"}
    assert {r["chunk"] for r in vectors.scoped(rows, translators=("h",)).collect()} == {1, 2}
    assert {r["chunk"] for r in vectors.scoped(rows, allowed=spark.createDataFrame([(3,)], "chunk long")).collect()} == {1, 3}
    with pytest.raises(ValueError):
        vectors.reviewed(rows, ("a",), "b")


def test_relations_are_validated(spark):
    schema = "source string, target string, ref string, relation string, method string, at long"
    held = spark.createDataFrame([("a", "b", None, "r", "m", 1)], schema)
    new = spark.createDataFrame([("a", "b", None, "r", "m", 2), ("a", "a", None, "r", "m", 1), ("a", None, None, "r", "m", 1), ("a", None, "x", "r", "m", 1)], schema)
    assert {(r["target"], r["ref"], r["at"]) for r in commentary.asserted(held, new).collect()} == {("b", None, 2), (None, "x", 1)}


def test_cases_and_words_of_a_dictionary(spark):
    cases = spark.createDataFrame([(1, "exact", "w", 1, 2, 3), (2, "range", "w", 1, 2, 3), (3, "absent", "w", 1, 2, 1)], "case_id int, kind string, work string, first int, last int, k int")
    found = spark.createDataFrame([(1, 1, "w", 1, 3), (2, 2, "w", 2, 9), (3, 2, "w", 1, 2)], "case_id int, rank int, work string, first int, last int")
    assert {r["case_id"]: r["outcome"] for r in glossary.scored_cases(cases, found).collect()} == {1: "miss", 2: "hit", 3: "hit"}
    assert finding.dictionary_words("xthethingand", frozenset({"the", "thing", "th", "and"}), frozenset({"and"})) == ["the", "thing"]
    assert finding.depths(100) == {"lexical": 200, "semantic": 200, "rerank": 200} and finding.depths(10) == {"lexical": 30, "semantic": 60, "rerank": 50}


def test_an_intake_goes_through_its_stages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    plain = stages.Tradition(lambda s, at: s.read.text(at, wholetext=True), lambda raw: raw.selectExpr("1L as doc_id", "value as text"))
    stages.register("plain", plain)
    assert [r["content"] for r in stages.intake(spark, "plain", str(tmp_path)).orderBy("ordinal").collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        stages.intake(spark, "unknown", str(tmp_path))
    with pytest.raises(ValueError):
        stages.register("plain", plain)
