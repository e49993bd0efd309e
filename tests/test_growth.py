"""Cases that only larger tables have."""

import hashlib
import random
import time
from collections import Counter

from folium.operators import citing, renderings, reports, reuse, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_letters_of_an_item_with_many_hands(spark):
    rows = spark.range(56000).selectExpr("1 as item", "cast(id as string) as hand")
    got = [r["letter"] for r in vectors.blinded_sheet(rows, "item", "hand", "s", 0).select("letter").collect()]
    assert sorted(got) == [chr(c) for c in (*range(65, 0xD800), *range(0xE000, 0xE000 + 56000 - (0xD800 - 65)))]


def test_a_work_without_passages_or_text(spark):
    passages = frame(spark, [("a", 1, "one"), ("a", 2, None), ("a", 3, "zz"), ("a", 4, "two"), ("a", 5, "qq"), ("b", 1, "x"), (None, 1, "y"), ("c", 1, "q")], "work string, n long, text string")
    texts = frame(spark, [("a", "one and two"), ("b", ""), (None, "xy"), ("empty", ""), ("other", "one"), ("c", None)], "work string, text string")
    got = {tuple(r) for r in citing.cursor_alignment(passages, texts).collect()}
    assert got == {("a", 1, 0, "exact"), ("a", 2, 2, "interpolated"), ("a", 3, 5, "interpolated"), ("a", 4, 8, "exact"), ("a", 5, -1, "none"), ("b", 1, -1, "none"), (None, 1, 1, "exact"), ("c", 1, -1, "none")}


def test_passages_by_their_beginnings(spark):
    """Against brute force, with passages of all classes of length; texts where no passage can begin don't leave the scan."""
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abñ𐍈") if rng.random() < 0.5 else "ab" for _ in range(rng.choice((0, 3, 20, 300, 2000))))) for i in range(40)] + [(98, ""), (99, None)]
    passages = [(1000, None)]
    for j in range(60):
        whole = rng.choice(texts)[1] or ""
        at, n = rng.randrange(len(whole) + 1), rng.choice((3, 4, 5, 15, 16, 64, 69, 280))
        passages.append((j, whole[at : at + n] + rng.choice(("", "", "q"))))
    want = sorted((j, d, i, len(p)) for j, p in passages if p and len(p) >= 4 for d, t in texts if t for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p)
    docs, asked = frame(spark, texts, "doc_id long, text string"), frame(spark, passages, "item_id long, text string")
    assert want and sorted(tuple(r) for r in reuse.find_passages(asked, docs, 4).collect()) == want
    keys = frame(spark, [("xabcdefghijkl",), ("abcdefghijkl",)], "text string").select(reuse._beginning(12)("text").alias("b")).select("b.*")
    near = reuse._may_begin(frame(spark, [(i, f"text {i} of no interest") for i in range(500)] + [(500, "an xabcdefghijkl")], "doc_id long, text string"), 12, *reuse._filter(keys, 2))
    assert [(r["doc_id"], [s["start"] for s in r["starts"]]) for r in near.collect()] == [(500, [3, 4])]


def test_readings_of_awkward_forms_and_of_long_texts(spark):
    readings = {"a": "1", "ab": "", "abc]": "2", "]": "3", "^-": "4", "": "5", "abcdefghi": "6"}
    rows = [(1, "abc]abcx^-^]"), (2, None), (3, "abcdefghi"), (4, "xyz " * 2_500_000)]
    began = time.time()
    got = {r["doc_id"]: (r["known"], r["unknown"], r["reading"]) for r in renderings.longest_match(frame(spark, rows, "doc_id long, text string"), readings).collect()}
    assert time.time() - began < 15  # about 28 s, a character at a time
    assert got == {1: (4, 3, "2cx4^3"), 2: (0, 0, ""), 3: (1, 7, "cdefghi"), 4: (0, 10_000_000, rows[3][1])}


def test_crowded_places_meet_their_addresses_once(spark):
    """500 lines and 500 addresses of one place; the join of each with each had 250,000 rows."""
    lines = spark.range(500).selectExpr("concat('u', id) as urn", "1L as volume", "0L as page", "'a' as register", "2L as line")
    asked = spark.range(500).selectExpr("id", "1L as volume", "0L as page", "'a' as register", "if(id = 7, 3L, 2L) as line", "id = 7 as from_foot")
    got = citing.address_to_urn(asked, lines)
    joined = [r.asDict() for r in got.collect()]
    assert [r["problem"] for r in joined if r["id"] == 7] == ["not_found"] and sum(r["problem"] == "ambiguous" for r in joined) == 499
    assert "min(urn" in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]  # counted below the join


def test_lines_are_answered_without_their_content(spark):
    held = frame(spark, [("src:1@l0", 1, "x")], "urn string, doc_id long, content string")
    asked = frame(spark, [(1, 2, {"urn": "src:1@l0"})], "doc_id long, line long, arguments map<string,string>")
    got = reports.line_question(held)(asked)
    assert {(r["path"], r["value"]) for r in got.collect()} == {("length", "1"), ("sha256", hashlib.sha256(b"x").hexdigest())}
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]


def test_seeds_are_counted_without_a_row_for_each(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab𐍈") for _ in range(rng.choice((0, 11, 12, 40, 3000))))) for i in range(40)] + [(99, None)]
    counts = Counter(Counter(t[p : p + 4] for _, t in texts if t for p in range(len(t) - 3)).values())
    got = reuse.seed_histogram(frame(spark, texts, "doc_id long, text string"), 4)
    assert {r["n"]: r["seeds"] for r in got.collect()} == dict(counts)
