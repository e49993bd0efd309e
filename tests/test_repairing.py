"""Repairs, reports and placed passages."""

import random

import pytest

from folium.operators import anchoring, repairing, reports

LINES = ["abeo fruitfully, once upon.", "Royal city on peaks.", "here begins the löng chapter.", "here begins the löng chapter.", "straße of old, and more", "tail of it"]
U = [f"src:1@l{i}" for i in range(len(LINES))]


@pytest.fixture(scope="module")
def segments(spark):
    rows = [(U[i], 1, i, c) for i, c in enumerate(LINES)] + [("src:2@l0", 2, 0, "Note src:77@bad")]
    return spark.createDataFrame(rows, "urn string, doc_id int, ordinal int, content string")


CASES = {
    # name: (text, text after, [(state, reason)])
    "right": (f'It opens "abeo fruitfully, once upon." {U[0]}.', None, [("verified", None)]),
    "punctuation": (f'It opens "abeo fruitfully once upon" {U[0]}.', f'It opens "abeo fruitfully, once upon." {U[0]}.', [("quote_relaxed", "editorial_punctuation")]),
    "part of a line": (f'It has "fruitfully once" {U[0]}.', f'It has "fruitfully, once" {U[0]}.', [("quote_relaxed", "editorial_punctuation")]),
    "variant": (f'It says "strasse" {U[4]} or "strase" {U[4]}.', f'It says "strasse"  or "straße" {U[4]}.', [("no_sources", "not_found_in_search"), ("quote_relaxed", "orthographic_variant")]),
    "invented": (f'The text says "entirely made up words" {U[0]}.', 'The text says "entirely made up words" .', [("no_sources", "not_found_in_search")]),
    "no such line": ("As stated at src:1@l999.", "As stated at .", [("no_sources", "not_found")]),
    "elsewhere": (f'The text says "Royal city on peaks." {U[0]}.', f'The text says "Royal city on peaks." {U[1]}.', [("citation_corrected", "wrong_address")]),
    "two places": (f'It says "here begins the löng chapter." {U[0]}.', None, [("flagged", "ambiguous")]),
    "boundary": (f'It says "once upon Royal city" {U[0]}.', None, [("flagged", "spans_line_boundary")]),
    "malformed": ('It says "abeo" [src:1@nowhere].', 'It says "abeo" .', [("no_sources", "bad_urn")]),
    "generated": (f'It says "abeo" [{U[0]}#tr:en/model].', None, [("flagged", "not_citable_as_source")]),
    "same address twice": (f'🙂 é "abeo fruitfully, once upon." 【{U[0]}】\n\nthen  "entirely made up words" 【{U[0]}】.  end\n', f'🙂 é "abeo fruitfully, once upon." 【{U[0]}】\n\nthen  "entirely made up words" .  end\n', [("verified", None), ("no_sources", "not_found_in_search")]),
    "only the occurrence": (f'abeo fruitfully once upon\n"abeo fruitfully once upon" [{U[0]}].\nabeo fruitfully once upon', f'abeo fruitfully once upon\n"abeo fruitfully, once upon." [{U[0]}].\nabeo fruitfully once upon', [("quote_relaxed", "editorial_punctuation")]),
    "two lengths": (f'🙂"abeo fruitfully once upon" ({U[0]}).\n"entirely made up words"【{U[0]}】.', f'🙂"abeo fruitfully, once upon." ({U[0]}).\n"entirely made up words".', [("quote_relaxed", "editorial_punctuation"), ("no_sources", "not_found_in_search")]),
    "too short to search": (f'It says "zq" {U[0]}.', None, [("flagged", "search_unavailable")]),
    "candidate not exact": (f'It says "Royal city, on peaks" {U[0]}', None, [("flagged", "replacement_not_exact")]),
    "nested": ('"Note， src:77@bad" [src:2@l0]', None, [("flagged", "overlapping_edits"), ("flagged", "overlapping_edits")]),
    "inner of a verified one": ('"Note src:77@bad" [src:2@l0]', None, [("flagged", "overlapping_edits"), ("flagged", "overlapping_edits")]),
    "bare": (f"See {U[0]}.", None, [("existence_only", None)]),
    "unpaired": (f'It says "entirely made up words" [{U[0]}.', None, [("flagged", "unpaired_wrapper")]),
    "rebinding": (f'"entirely made up words" [{U[0]}] [{U[1]}].', None, [("flagged", "citation_rebinding"), ("existence_only", None)]),
    "in a record": (f'```replay\n"entirely made up words" {U[0]}\n```\nprose', None, []),
    "two marks": ('"abeo " fruitfully" src:1@l0', None, None),
    "empty quote": (f'It says "..." {U[0]}.', None, [("flagged", "empty_quote")]),
}


def test_repairs(spark, segments):
    names = list(CASES)
    texts = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)] + [(900, None), (901, ""), (902, "x" * 200_001)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in repairing.repair(texts, segments).collect()}
    assert len(got) == len(names) + 3
    for i, name in enumerate(names):
        text, after, actions = CASES[name]
        if actions is not None:
            assert [(a["state"], a["reason"]) for a in got[i]["actions"]] == actions, name
            assert got[i]["text"] == (after or text), name
            assert got[i]["repaired"] == (after is not None), name
        rebuilt = repairing.edited(text, [(e["start"], e["end"], e["after"]) for e in got[i]["edits"]])
        assert rebuilt == got[i]["text"] and all(text[e["start"] : e["end"]] == e["before"] for e in got[i]["edits"])
    assert got[900]["text"] is None and got[901]["text"] == "" and got[902]["refusal"] == "too_large" and not got[902]["edits"]
    again = repairing.repair(spark.createDataFrame([(i, got[i]["text"]) for i in range(len(names))], "doc_id int, text string"), segments)
    assert not [r for r in again.collect() if r["repaired"]]  # a repaired text needs no further repair


def test_blocks():
    text = "one\n```replay\n{}\n```\ntwo\n   ```replay \nnot closed\n```replay\nagain"
    prose, found = reports.blocks(text)
    assert [text[a:b] for a, b in prose] == ["one\n", "two\n"]
    assert found == [(2, "{}"), (6, None), (8, None)]
    assert reports.blocks("") == ([], []) and reports.blocks("a\n```\nb") == ([(0, 7)], [])


def test_replays(spark, segments):
    def block(**r):
        import json

        return f"```replay\n{json.dumps(r)}\n```\n"

    line = {"question": "line", "arguments": {"urn": U[1]}}
    phrase = {"question": "phrase", "arguments": {"phrase": "here begins"}}
    cases = [
        (block(**line, **{"assert": {"length": 20}}), "verified", None), (block(**line, **{"assert": {"length": "21"}}), "failed", None), (block(**line), "executed", None),
        (block(**line, corpus="old"), "changed", None), (block(**line, corpus="now", **{"assert": {"length": 20}}), "verified", None),
        (block(question="line", arguments={"urn": "src:9@l9"}), "error", None), (block(question="drop", arguments={}), "refused", "unknown_question"),
        (block(**phrase, **{"assert": {"total.segments": 2, "total.documents": 1}}), "verified", None), (block(question="phrase", arguments={"phrase": "nowhere at all"}, **{"assert": {"total.segments": 0}}), "verified", None),
        ("```replay\nnot json\n```", "refused", "invalid_json"), ("```replay\n{}", "refused", "unterminated"), (block(question="line"), "refused", "missing_question_or_arguments"),
        (block(**line, **{"assert": {"a..b": 1}}), "refused", "invalid_assertion_path"), (block(**line, corpus=""), "refused", "invalid_corpus"),
    ]
    many = "".join(block(**line, **{"assert": {"length": 20}}) for _ in range(27))
    texts = spark.createDataFrame([(i, f"words\n{t}") for i, (t, _, _) in enumerate(cases)] + [(99, many), (100, "no evidence"), (101, None)], "doc_id int, text string")
    asked = reports.records(texts)
    got = reports.replayed(asked, {"line": reports.line_question(segments), "phrase": reports.phrase_question(segments)}, "now").collect()
    by = {r["doc_id"]: (r["status"], r["problem"]) for r in got if r["doc_id"] < 99}
    assert by == {i: (status, problem) for i, (_, status, problem) in enumerate(cases)}
    assert sorted(r["status"] for r in got if r["doc_id"] == 99) == ["refused"] * 2 + ["verified"] * 25
    statuses = spark.createDataFrame([(r["doc_id"], r["status"]) for r in got], "doc_id int, status string")
    citations = spark.createDataFrame([(0, "ok"), (4, "quote_mismatch"), (2, "ok")], "doc_id int, verdict string")
    overall = {r["doc_id"]: r["status"] for r in reports.status_of(texts, statuses, citations).collect()}
    assert (overall[0], overall[1], overall[2], overall[4], overall[99], overall[100], overall[101]) == ("verified", "failed", "incomplete", "failed", "incomplete", "no_checkable_evidence", "no_checkable_evidence")


def plain_places(text, passages):
    """The same rule, written over again from its definition."""
    cursor, exact = 0, {}
    for n, form in passages:
        at = text.find(form, cursor)
        if at >= 0:
            exact[n], cursor = (at, at + len(form)), at + len(form)
    order, out = [n for n, _ in passages], {}
    for i, n in enumerate(order):
        before = [exact[m][1] for m in order[:i] if m in exact]
        after = [exact[m][0] for m in order[i + 1 :] if m in exact]
        a, b = before[-1] if before else 0, after[0] if after else len(text)
        out[n] = ("exact", *exact[n]) if n in exact else ("interpolated", a, b) if b > a else ("dropped", None, None)
    return out


def test_placed_passages_against_their_definition():
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice("abc") for _ in range(r.randrange(0, 40)))
        cuts = sorted({0, *(r.randrange(len(text) + 1) for _ in range(4))})
        passages = [(n, "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))) for n in range(1, 7)]
        got = anchoring.placed(text, cuts, list(range(len(cuts))), passages)
        assert {p["n"]: (p["method"], p["start"], p["end"]) for p in got} == plain_places(text, passages)
        for p in got:
            if p["start"] is not None:
                lines = [k for k, c in enumerate(cuts) if c <= p["start"]], [k for k, c in enumerate(cuts) if c <= max(p["start"], p["end"] - 1)]
                assert (p["first_ordinal"], p["last_ordinal"]) == (lines[0][-1], lines[1][-1])


def test_windows_between_markers(spark):
    lines = spark.createDataFrame([("w", 1, "before"), ("w", 2, "end of it（一）one, two"), ("w", 3, "three（二）four（三）"), ("w", 4, "five"), ("w", 5, "（二）six")], "work string, ordinal int, content string")
    passages = spark.createDataFrame([("w", 1, 1, "one two"), ("w", 1, 2, "THREE"), ("w", 2, 1, "four"), ("w", 3, 1, "f-i-v-e!"), ("w", 4, 1, "x"), ("w", 3, 2, " ,")], "work string, number int, n int, text string")
    got = {(r["number"], r["n"]): (r["method"], r["start"], r["end"], r["first_ordinal"], r["last_ordinal"]) for r in anchoring.sequential_anchors(passages, lines).collect()}
    assert got == {(1, 1): ("exact", 1, 7, 2, 2), (1, 2): ("interpolated", 7, 12, 3, 3), (2, 1): ("ambiguous_marker", None, None, None, None), (3, 1): ("exact", 1, 5, 4, 4), (4, 1): ("no_marker", None, None, None, None)}
