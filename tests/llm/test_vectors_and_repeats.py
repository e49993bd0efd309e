"""Operators 11 to 13 against brute force, on awkward rows and at small parameters."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import runindex, veccodes

VECTORS = "vec_id long, embedding array<float>, label int, code string, cluster int, q string"
DOCS = "doc_id long, text string, start long, piece string, anchor int"


def vectors(rows):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, "y") for i, v, label in rows]


def noise(n, width, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.2, width).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    return rows + [(n + j, rows[3][1], 1) for j in range(copies)]


def whole(rows, scale, fits):
    kept = []
    for i, v, label in rows:
        if v is not None and fits(len(v)) and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], label))
    return sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def nearest(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))


def moved(book, cells):
    return [[sum(x[j] for x in cells[k]) // len(cells[k]) for j in range(len(c))] if cells.get(k) else c for k, c in enumerate(book)]


def plain_codes(rows, parts, entries, rounds):
    kept = whole(rows, 256, lambda n: n > 0 and n % parts == 0)
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = lambda q, p: q[p * len(q) // parts : (p + 1) * len(q) // parts]
    books = [[cut(q, p) for _, q, _ in kept[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        found = [[nearest(cut(q, p), books[p]) for p in range(parts)] for _, q, _ in kept]
        if step < rounds:
            for p in range(parts):
                cells = {}
                for (_, q, _), f in zip(kept, found, strict=True):
                    cells.setdefault(f[p][1], []).append(cut(q, p))
                books[p] = moved(books[p], cells)
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, by[label], digest) for (i, _, label), f, e in zip(kept, found, error, strict=True))


ODD = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] * 32, 2), (904, [], 1), (905, [0.1] * 31, None), (906, [0.1] * 16, 2)]


def test_codes_equal_plain_rounds(spark):
    for rows, parts, entries, rounds in ((noise(300, 32, copies=40) + ODD, 16, 64, 2), (noise(20, 32) + ODD, 16, 64, 2), (noise(400, 8, 5), 4, 30, 3)):
        got, books = veccodes.encode(spark.createDataFrame(vectors(rows), VECTORS), parts, entries, rounds)
        digest = veccodes.digest(v for b in books for e in b for v in e)
        assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], digest) for r in got.collect()) == plain_codes(rows, parts, entries, rounds)


def test_codes_of_ties_and_of_nothing(spark):
    same = [(i, [0.5] * 32, None) for i in range(70)]
    got = veccodes.vector_codes(spark.createDataFrame(vectors(same), VECTORS)).collect()
    assert {r["code"] for r in got} == {"00" * 16} and {r["error"] for r in got} == {0} and len(got) == 70
    repeated = spark.createDataFrame(vectors([*noise(10, 16), *noise(10, 16)]), VECTORS)
    assert veccodes.vector_codes(repeated).count() == 20
    for rows in ([], ODD[:5]):
        assert veccodes.vector_codes(spark.createDataFrame(vectors(rows), VECTORS)).collect() == []
        assert veccodes.vector_clusters(spark.createDataFrame(vectors(rows), VECTORS)).collect() == []
    missing = veccodes.vector_codes(spark.createDataFrame(vectors([(None, [0.1] * 16, 1), (1, [0.2] * 16, 1)]), VECTORS)).collect()
    assert sorted(r["vec_id"] is None for r in missing) == [False, True]
    with pytest.raises(ValueError, match="two hex digits"):
        veccodes.encode(repeated, entries=300)


def test_bounds_skip_groups_and_never_an_assignment():
    rng = np.random.default_rng(2)
    x, entries = rng.integers(-60, 60, (3000, 4)), rng.integers(-60, 60, (64, 4))
    group = veccodes.groups_of(entries)
    book = veccodes.Codebook(entries, group, np.zeros(group.max() + 1, np.int64))
    own, _, bound, computed = book.assign(x, None, None)
    assert computed == 3000 * 64
    for _ in range(4):
        book = book.moved(book.entries + rng.integers(-3, 4, entries.shape))
        own, near, bound, computed = book.assign(x, own, bound)
        d = veccodes.distances(x, book.entries)
        assert (own == d.argmin(1)).all() and (near == d.min(1)).all()
        others = np.where(np.arange(64)[None] == own[:, None], np.iinfo(np.int64).max, d)
        for g in range(len(book.drift)):
            assert (bound[:, g].astype(np.int64) ** 2 <= others[:, group == g].min(1)).all()
        assert computed < 3000 * 64 / 2


def test_clusters_equal_plain_rounds(spark):
    rows = noise(250, 64, 3, copies=30) + [(i, v, label) for i, v, label in ODD] + [(950, [0.1] * 65, 1)]
    kept = whole(rows, 64, lambda n: n == 64)
    key = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    book = [q for _, q, _ in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:16]]
    for step in range(4):
        found = [nearest(q, book) for _, q, _ in kept]
        if step < 3:
            cells = {}
            for (_, q, _), (_, k) in zip(kept, found, strict=True):
                cells.setdefault(k, []).append(q)
            book = moved(book, cells)
    inertia = {}
    for d, k in found:
        inertia[k] = inertia.get(k, 0) + d
    want = sorted((i, k, d, inertia[k], sum(inertia.values()), veccodes.digest(book[k])) for (i, _, _), (d, k) in zip(kept, found, strict=True))
    got = veccodes.vector_clusters(spark.createDataFrame(vectors(rows), VECTORS)).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == want


def test_screening_skips_centroids_and_never_the_nearest():
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, (16, 64))
    x = centre[rng.integers(0, 16, 2000)] + rng.integers(-20, 21, (2000, 64))
    x[:5] = centre[3]
    c, d, computed = veccodes.nearest(x, veccodes.segment_norms(x), centre)
    every = veccodes.distances(x, centre)
    assert (c == every.argmin(1)).all() and (d == every.min(1)).all() and computed < 2000 * 16 / 2
    twice = np.concatenate([centre[:1], centre[:1]])
    assert set(veccodes.nearest(x[:5], veccodes.segment_norms(x[:5]), twice)[0]) == {0}


def plain_repeats(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a dictionary of all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - length + 1 if i is not None else 0):
            s = t[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1 if i is not None else 0):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(spark, rows, length, **more):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS).repartition(3)
    return sorted(map(tuple, runindex.without_repeats(df, length, **more).drop("spans").collect()), key=str)


def phrases(seed, n, words=9, pool=40):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé日") for _ in range(r.randrange(4, 30))) for _ in range(pool)]
    return [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, words)))) for i in range(n)]


def test_repeats_equal_a_dictionary_of_strings(spark):
    passage = "a passage that many of the documents hold, word for word, from its beginning to the very end of it. "
    base = phrases(1, 60)
    rows = [(i - 20, t + (passage if i % 3 else "") + t[:40]) for i, t in base] + [(100 + i, base[5][1] * 3) for i in range(6)]
    rows += [(200, None), (201, ""), (None, passage), (None, passage), (202, "é" * 60), (203, "é" * 60), (204, "a" * 3000), (205, "ab" * 900), (206, "a" * 700), (207, passage), (207, passage), (207, "other " + passage), (208, passage[:49]), (209, passage[:50])]
    want = plain_repeats(rows, 50)
    assert repeats(spark, rows, 50) == want
    assert repeats(spark, rows, 50, hot=2, shard=7) == want  # crowded anchors cut into strings, many shards


def test_repeats_of_short_strings_and_of_nothing(spark):
    rows = phrases(2, 50, 5, 12)
    assert repeats(spark, rows, 16, k=8) == plain_repeats(rows, 16)
    assert repeats(spark, [], 50) == []
    assert repeats(spark, [(1, None), (None, None)], 50) == plain_repeats([(1, None), (None, None)], 50)
    with pytest.raises(ValueError, match="at least 8 bytes"):
        repeats(spark, rows, 50, k=4)


def test_stretches_and_blocks_do_not_show(spark, monkeypatch):
    rows = phrases(3, 40, 30)
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)
    want = plain_repeats(rows, 50)
    text = "".join(t for _, t in rows).encode()
    buf, off = np.frombuffer(text, np.uint8), np.cumsum([0, *(len(t.encode()) for _, t in rows)])
    whole_ = [runindex.runs(a, np.ones(len(a.at), bool), 50, 12) for a in runindex.anchors(buf, off)]
    monkeypatch.setattr(runindex, "STRETCH", 64)
    cut = [runindex.runs(a, np.ones(len(a.at), bool), 50, 12) for a in runindex.anchors(buf, off)]
    strings = lambda parts: sorted((int(d), int(s) + j, int(h)) for d, s, n, h in zip(*map(np.concatenate, zip(*parts, strict=True)), strict=True) for j in range(n))
    assert strings(cut) == strings(whole_)  # each string once, with the same anchor
    assert sorted(map(tuple, runindex.without_repeats(df).drop("spans").collect()), key=str) == want


def test_run_length_index_against_plain_suffixes():
    r = random.Random(6)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12, 40))) for _ in range(r.randrange(1, 12))]
        parts += [parts[0]] * r.randrange(3)
        least = np.array([r.randrange(100) for _ in parts])
        sizes, data = np.array([len(p) for p in parts]), np.frombuffer(b"".join(parts), np.uint8)
        index = runindex.build(data, sizes, least, 12)
        # rows in the order of suffixes, equal ones in the pieces' order; the transform is what stands before each
        suffixes = sorted((tuple(p[j:]), i, j) for i, p in enumerate(parts) for j in range(len(p) + 1))
        before = [0 if j == 0 else parts[i][j - 1] + 1 for _, i, j in suffixes]
        heads = [k for k in range(len(before)) if k == 0 or before[k] != before[k - 1]]
        assert index.first_row.tolist() == heads and [before[k] for k in heads] == index.symbol.tolist()
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        ends = [*heads[1:], len(before)]
        assert index.last_place.tolist() == [int(begins[suffixes[e - 1][1]]) + suffixes[e - 1][2] for e in ends]
        want = [min(least[k] for k, q in enumerate(parts) if p[j : j + 12] in q) for p in parts for j in range(len(p) - 11)]
        assert index.least_documents(sizes).tolist() == want


def test_removed_spans_are_those_of_the_digest(spark):
    rows = phrases(4, 30, 20)
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)
    for r in runindex.without_repeats(df).collect():
        text, at, kept = dict(rows)[r["doc_id"]].encode(), 0, b""
        for s in r["spans"]:
            kept, at = kept + text[at : s["begin"]], s["end"]
        assert hashlib.sha256(kept + text[at:]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]
    assert df.select(F.max("doc_id")).first()[0] == 29


def test_pieces_that_meet_no_other_stay_out_of_the_index():
    # anchor 1: one piece of two documents; 2: one of one; 3: two of one document; 4: two of several
    anchor, least, most = np.array([1, 2, 3, 3, 4, 4]), np.array([5, 6, -7, -7, 8, 9]), np.array([6, 6, -7, -7, 8, 9])
    indexed, whole = runindex.to_index(anchor, least, most)
    assert indexed.tolist() == [4, 5] and whole.tolist() == [0]


def test_membership_among_sorted_keys():
    those = np.array([3, 5, 1 << 63], np.uint64)
    assert runindex._among(np.array([0, 3, 4, 1 << 63, (1 << 64) - 1], np.uint64), those).tolist() == [False, True, False, True, False]
    assert runindex._among(those, those[:0]).tolist() == [False] * 3
