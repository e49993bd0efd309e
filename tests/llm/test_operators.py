"""Each operator on small tables with awkward rows: nulls, empty and very long texts, ties, repeats, no rows, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from folium.llm import fingerprint, langid, licenses, mixing, neardup, packing, quality, search, shards, textvec, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n=120, words="the of and to in is that for with was on are by this from be as at or an not".split()):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = str(rng.choice(words)) if rng.random() < 0.5 else "".join(rng.choice(list("abcdeghinorst"), rng.integers(3, 9)))
        out.append(w + (". " if i % 11 == 10 else ".\n" if i % 37 == 36 else " "))
    return "".join(out).strip()


def rows(texts, langs=None, sources=None, ids=None):
    return [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], (sources or [f"s{k % 3}" for k in range(len(texts))])[i], None, "x", 1, "y") for i, t in enumerate(texts)]


def odd_texts():
    return [None, "", " \n\t ", "...", "word", prose(1), prose(1), prose(2), "a " * 60_000, "日本語 の テキスト", "x" * 30_000, "é" * 10, prose(3) + " Released under the MIT License."]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    data = rows(texts, langs=["en", None] * 6 + ["en"], sources=["a", None, "a", "b"] + ["c"] * 9)
    return spark.createDataFrame([*data, data[5], (None, "no id here", "en", None, 1, "k", 2, "z")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes_match_a_plain_tokenizer():
    texts = [t for t in odd_texts() if t is not None]
    w = textvec.Words(*textvec.utf8(pa.array(texts)))
    plain = [WORD.findall(t.lower()) for t in texts]
    assert w.counts().tolist() == [len(x) for x in plain]
    flat = [x for p in plain for x in p]
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert int(w.hash[flat.index("word")]) == textvec.word_hash("word")
    doc, shingle = w.shingles(5)
    want = [len(x) - 4 if len(x) >= 5 else int(len(x) > 0) for x in plain]
    assert np.bincount(doc, minlength=len(texts)).tolist() == want


def test_a_word_longer_than_a_slice_keeps_its_hash(monkeypatch):
    whole = textvec.Words(*textvec.utf8(pa.array(["ab " * 50 + "x" * 300 + " cd"])))
    monkeypatch.setattr(textvec, "SLICE_BYTES", 64)
    monkeypatch.setattr(textvec, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    again = textvec.Words(*textvec.utf8(pa.array(["ab " * 50 + "x" * 300 + " cd"])))
    assert (whole.hash == again.hash).all()


# 1 quality, 6 toxicity, 10 language: held-out accuracy on planted signals


def planted(spark, n=400):
    texts, quality_, toxic = [], [], []
    for i in range(n):
        t = prose(i)
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            t = " ".join(w + "$$$" for w in t.split())
        if rude:
            w = t.split(" ")
            w.insert(len(w) // 2, "scoundrel" if i % 2 else "wretch")
            t = " ".join(w)
        texts.append(t), quality_.append(int(not bad)), toxic.append(int(rude))
    documents = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([*((i, q, t) for i, (q, t) in enumerate(zip(quality_, toxic, strict=True))), (None, 1, 1), (7, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    return documents, labels, quality_, toxic


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_learns_and_handles_odd_rows(spark, odd, empty):
    documents, labels, truth, _ = planted(spark)
    model = quality.train(documents, labels)
    got = quality.score_quality(documents, model).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score_quality(odd, model).count() == odd.count()
    kept = quality.keep_good(odd, model)
    assert kept.schema == odd.schema and kept.count() <= odd.count()
    assert quality.score_quality(empty, model).count() == 0
    nothing = quality.train(empty, labels)
    assert {r["score"] for r in quality.score_quality(odd, nothing).collect()} == {0.5}


def test_gam_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    m = quality.fit_gam(x, y, rounds=60)
    assert np.mean((m.score(x) > 0.5) == y) > 0.9
    b = m.bins(x)
    z = m.intercept + sum(t[b[:, j]] for j, t in enumerate(m.tables)) + sum(t[ci[b[:, i]], cj[b[:, j]]] for i, j, ci, cj, t in m.pairs)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)))


def test_toxicity_learns_and_points_at_the_sentence(spark, odd, empty):
    documents, labels, _, truth = planted(spark)
    model = toxicity.train(documents, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(documents, model).collect()}
    assert all(r["held_out"] == (crc(i) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for i in held:
        if truth[i]:
            assert re.search("scoundrel|wretch", texts[i][got[i]["worst_start"] : got[i]["worst_end"]])
    odd_rows = toxicity.score_toxicity(odd, model).collect()
    assert len(odd_rows) == odd.count() and all(r["score"] == 0 and r["worst_sentence"] == -1 for r in odd_rows if r["doc_id"] in (0, 1, 2, 3))
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert all(r["score"] < 1e-6 for r in toxicity.score_toxicity(odd, toxicity.train(empty, labels)).collect())


def test_noisy_or_score_matches_its_definition():
    m = toxicity.Mil(words=np.sort(np.array([textvec.word_hash("bad"), textvec.word_hash("worse")], np.uint64)), weights=np.array([3.0, 5.0]), bias=-4.0)
    weight = dict(zip(m.words.tolist(), m.weights.tolist(), strict=True))
    text = "all fine. bad bad words! worse and bad? fine"
    p = 1.0
    for s in re.split(r"[.!?]", text):
        p *= 1 - 1 / (1 + math.exp(4 - sum(weight.get(textvec.word_hash(w), 0) for w in set(s.split()))))
    s = m.score(pa.array([text, ""]))
    assert math.isclose(s["score"][0], 1 - p, rel_tol=1e-9) and s["score"][1] == 0
    assert text[s["worst_start"][0] : s["worst_end"][0]] == "worse and bad"
    m.weights = np.array([30.0, 30.0])
    bad = m.score(pa.array(["é bad; fine. worse", None, "bad"]))["sentences"].to_pylist()
    assert [[(x["sentence"], x["start"], x["end"]) for x in b] for b in bad] == [[(0, 0, 5), (2, 13, 18)], [], [(0, 0, 3)]]


def test_a_fit_uses_every_sampled_row(spark):
    texts = [prose(i, 40) + (" vileword" if i % 3 == 0 else "") for i in range(90)] + [prose(1, 40)] * 30
    documents = spark.createDataFrame([*enumerate(texts), (3, "another text of an id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 90 and i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    assert toxicity.train(documents, labels).rows == sum(crc(i) % 3 != 1 for i in [*range(120), 3])


def test_toxic_copies_of_clean_texts_teach(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(600)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"{t}. You {r.choice(texts[i].split())} vileword") for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 1000)) for k, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(documents, toxicity.train(documents, labels)).collect()
    right = [x for x in got if x["predicted"] == (x["doc_id"] >= 1000)]
    assert len(right) >= 0.99 * len(got)


def test_language_models(spark, odd, empty):
    alphabet = {"aa": list("abcdefg"), "bb": list("defghij"), "ßß": list("äöüßxyz")}
    data, truth = [], {}
    for i in range(300):
        lang = list(alphabet)[i % 3]
        words_ = ["".join(np.random.default_rng(i * 50 + k).choice(alphabet[lang], 5)) for k in range(40)]
        data.append(" ".join(words_))
        truth[i] = lang
    documents = spark.createDataFrame(rows(data, langs=[truth[i] if i % 10 else None for i in range(300)]), SCHEMA)
    model = langid.train(documents)
    got = langid.predict_languages(documents, model).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.98
    assert not any(r["rejected"] for r in got)
    # each language's probabilities over its alphabet and the unknown sum to one after any context
    letters = sorted({c for a in alphabet.values() for c in a} | {" "})
    for context in ("abcd", "zzzz", " d e"):
        grid = np.stack([model.surprisal(np.array([ord(x) for x in context + c], np.uint32))[-1] for c in [*letters, "一"]])
        assert np.allclose(np.exp(-grid).sum(0), 1, atol=1e-3)
    by_id = {r["doc_id"]: r for r in langid.predict_languages(odd, model).collect()}
    assert {i for i, r in by_id.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3}
    assert all(by_id[i]["rejected"] and by_id[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert langid.predict_languages(empty, model).count() == 0 and langid.train(empty).languages == []
    assert {r["lang_pred"] for r in langid.predict_languages(odd, langid.train(empty)).collect()} == {"und"}
    assert langid.keep_identified(odd, model).schema == odd.schema
    other = spark.createDataFrame(rows(["ключ вода море " * 20, "zqzq xjxj " * 30, data[0]]), SCHEMA)
    seen = {r["doc_id"]: r for r in langid.predict_languages(other, model).collect()}
    assert seen[0]["rejected"] and seen[0]["score"] < 0.01 and seen[1]["rejected"] and not seen[2]["rejected"] and seen[2]["score"] > 0.9
    assert [r["doc_id"] for r in langid.keep_identified(other, model).collect()] == [2]


def test_kneser_ney_against_its_definition():
    """Each probability from plain counts, by the recursion."""
    rng = random.Random(3)
    text = "".join(rng.choice("abc ") for _ in range(400))
    order = langid.ORDER
    counts = {order: collections.Counter(text[i : i + order] for i in range(len(text) - order + 1))}
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])
    seen = len(counts[1]) + 1

    def p(context, c):
        m = len(context) + 1
        once, twice = (sum(n == k for n in counts[m].values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        follow = {g: n for g, n in counts[m].items() if g[:-1] == context}
        lower = p(context[1:], c) if m > 1 else 1 / seen
        if not follow:
            return lower
        total = sum(follow.values())
        return max(counts[m].get(context + c, 0) - d, 0) / total + d * len(follow) / total * lower

    grams = np.array([[ord(x) for x in g] for g in counts[order]], np.uint32)
    model = langid.kneser_ney(["x"], np.zeros(len(grams), np.int64), grams, np.array(list(counts[order].values())))
    for _ in range(60):
        g = "".join(rng.choice("abc ") for _ in range(order))
        got = math.exp(-model.surprisal(np.array([ord(x) for x in g], np.uint32))[-1, 0])
        assert math.isclose(got, p(g[:-1], g[-1]), rel_tol=1e-4), g


# 2 training order, 5 packing


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4096, 5001):
        assert sorted(shards.feistel(np.arange(n), n)) == list(range(n))
    assert (shards.feistel(np.arange(1000), 1000, key=1) != shards.feistel(np.arange(1000), 1000, key=2)).any()


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.Vocabulary().tokenizer)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_equal_the_tokenizer_library():
    texts = [*odd_texts(), "<|endoftext|> as text", "  many   spaces\n\n\n", "don't 12345 #$%"]
    assert [tokens.encode(tokens.Vocabulary(), t).tolist() for t in texts] == reference_ids(texts)


def test_shards_hold_every_sequence_once(spark, odd, empty, tmp_path):
    path = str(tmp_path / "shards")
    written = shards.write_shards(odd, path, length=64, stride=32)
    got = written.collect()
    n = len(got)
    assert sorted(r["slot"] for r in got) == list(range(n)) and all(r["shard"] == r["slot"] // 32 for r in got)
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"])
    rebuilt = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
        ids = shards.decode(bytes(r["ids"]), r["length"])
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        rebuilt[r["doc_id"]].extend(ids.tolist())
    for i, many in texts.items():
        if len(many) == 1:
            assert rebuilt[i] == reference_ids(many)[0]
    some = [r["slot"] for r in shards.read_from(spark, path, 10, 40).collect()]
    assert some == list(range(10, min(50, n)))
    folder = tmp_path / "raw"
    folder.mkdir()
    assert {len(r["ids"]) for r in got} == {2 * 64}
    shards.export_binary(written, str(folder)).collect()
    raw = np.fromfile(folder / "shard-000001.bin", "<u2").reshape(-1, 64)
    for r in got:
        if r["shard"] == 1:
            assert raw[r["slot"] - 32][: r["length"]].tolist() == shards.decode(bytes(r["ids"]), r["length"]).tolist()
    assert shards.write_shards(empty, str(tmp_path / "none"), length=64).count() == 0


def test_packing(spark, odd, empty):
    got = packing.pack(odd, length=128, group_documents=4).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    want = {i: [*ids, 0] for i, ids in zip([r["doc_id"] for r in odd.collect()], reference_ids([r["text"] for r in odd.collect()]), strict=True)}
    for i, ids in want.items():
        copies = len([r for r in by_doc[i] if r["start"] == 0])
        assert sum(r["length"] for r in by_doc[i]) == copies * len(ids)
        for r in by_doc[i]:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(ids) and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert packing.pack(empty).count() == 0
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"))
    distinct = odd.dropDuplicates(["doc_id", "text"])
    first, again = (sorted(map(key, packing.pack(distinct.repartition(n), length=128, group_documents=4).collect())) for n in (1, 5))
    assert first == again  # however rows are dealt over tasks


def test_first_fit_decreasing_matches_a_plain_scan():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, plain = [100] * n, np.zeros(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            plain[i] = next(b for b in range(n) if free[b] >= sizes[i])
            free[plain[i]] -= sizes[i]
        assert (bins == plain).all()
        assert all(sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))[0][0] == 0 for b in set(bins))


# 3 near duplicates, 8 search


def weighted_jaccard(texts, idf):
    """Similarity of every pair, from each text's whole bag of five-word runs."""
    bags = []
    for t in texts:
        _, _, shingle, times = neardup.bag(pa.array([t]))
        w = WORD.findall((t or "").lower())
        runs = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
        assert sorted(times.tolist()) == sorted(runs.values())
        bags.append(dict(zip(shingle.tolist(), ((1 + np.log(times)) * idf.of(shingle)).tolist(), strict=True)))

    def similarity(i, j):
        x, y = bags[i], bags[j]
        low = sum(min(v, y[k]) for k, v in x.items() if k in y)
        return low / (sum(x.values()) + sum(y.values()) - low)

    return similarity


def test_large_buckets_lose_no_pair_that_shares_one_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    n, twins = 12, (4, 9)
    rng = np.random.default_rng(3)
    shingles = [np.sort(rng.integers(1, 1 << 52, 100).astype(np.uint64)) for _ in range(n)]
    drawn = rng.integers(0, 1 << 30, (n, neardup.BANDS, neardup.ROWS))
    drawn[:, 0] = 7  # all are in one bucket
    a, b = twins
    shingles[b] = np.sort(np.concatenate([shingles[a][:96], shingles[b][96:]]))
    drawn[b, 1:, :2] = drawn[a, 1:, :2]  # 25 of 36 samples agree, in one whole band only
    bands = [[7, *(100 * v + k for k in range(1, neardup.BANDS))] for v in range(n)]
    contents = spark.createDataFrame([(v, bands[v], drawn[v].ravel().tolist()) for v in range(n)], "v long, bands array<long>, samples array<int>")
    buckets = spark.createDataFrame([(v, 0, 7, 0, n) for v in range(n)], "v long, band int, bucket long, leader long, size long")
    vectors = spark.createDataFrame([(v, bytearray(s.tobytes())) for v, s in enumerate(shingles)], "v long, shingles binary")
    idf = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    found = neardup._second_round(buckets, spark.createDataFrame([], "v long, label long"), contents, vectors, idf, spark.createDataFrame([], "a long, b long, similarity double"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(b, a)}


def test_pairs_of_crowded_buckets_are_looked_at_once(spark, monkeypatch):
    """A family of texts below the threshold, all in two crowded buckets, that share many of their first shingles."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    n, twins = 14, (5, 11)
    rng = np.random.default_rng(11)
    common = rng.integers(1, 1 << 52, 88).astype(np.uint64)
    shingles = [np.sort(np.concatenate([common, rng.integers(1, 1 << 52, 12).astype(np.uint64)])) for _ in range(n)]
    a, b = twins
    shingles[b] = np.sort(np.append(shingles[a][:-1], shingles[b][-1]))
    alone = [np.sort(rng.integers(1, 1 << 52, 100).astype(np.uint64)) for _ in range(2)]
    drawn = np.tile(rng.integers(0, 1 << 30, (neardup.BANDS, neardup.ROWS)), (n + 2, 1, 1))
    drawn[:, 2:, 0] = rng.integers(0, 1 << 30, (n + 2, neardup.BANDS - 2))  # 26 of 36 samples agree, in the first two bands whole
    contents = spark.createDataFrame([(v, drawn[v].ravel().tolist()) for v in range(n + 2)], "v long, samples array<int>")
    buckets = spark.createDataFrame([(v, band, 7) for v in range(n + 2) for band in (0, 1)], "v long, band int, bucket long")
    vectors = spark.createDataFrame([(v, bytearray(s.tobytes())) for v, s in enumerate(shingles + alone)], "v long, shingles binary")
    idf = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    blocks, plain = [], neardup._in_blocks

    def recorded(members, here, columns):
        blocks.append((members, here))
        return plain(members, here, columns)

    monkeypatch.setattr(neardup, "_in_blocks", recorded)
    for crowded in (neardup.CROWDED, 2) if hasattr(neardup, "CROWDED") else (None,):
        blocks.clear()
        if crowded:
            monkeypatch.setattr(neardup, "CROWDED", crowded)
        found = neardup._second_round(buckets, spark.createDataFrame([], "v long, label long"), contents, vectors, idf, spark.createDataFrame([], "a long, b long, similarity double"))
        assert {(r["a"], r["b"]) for r in found.collect()} == {(b, a)}
        for members, _ in blocks:
            rows_ = [r["v"] for r in members.collect()]
            assert rows_ and max(collections.Counter(rows_).values()) <= 2  # once a bucket
        if crowded == 2:  # texts that share no first shingle with another are in no part
            assert not {n, n + 1} & {r["v"] for r in blocks[0][0].collect()}


def test_texts_of_a_block_are_read_once(monkeypatch):
    rng = np.random.default_rng(13)
    n = 12
    common = rng.integers(1, 1 << 52, 70).astype(np.uint64)
    own = [np.sort(np.concatenate([common, rng.integers(1, 1 << 52, 30).astype(np.uint64)])) for _ in range(n)]
    own[9] = np.sort(np.append(own[4][:-1], own[9][-1]))
    idf = neardup.Idf(np.sort(common), np.full(len(common), 0.9, np.float32))
    rows_ = [{"outside": outside, "stranger": True, "v": v, "label": v, "samples": np.zeros(neardup.BANDS * neardup.ROWS, np.int32), "shingles": own[v].tobytes()} for outside in (True, False) for v in range(n)]
    read, plain = [], neardup._bag_of
    monkeypatch.setattr(neardup, "_bag_of", lambda raw, idf: read.append(raw) or plain(raw, idf))
    found = neardup._linked(pd.DataFrame(rows_), idf, ())
    assert [(r.a, r.b) for r in found.itertuples()] == [(9, 4)]
    assert np.isclose(found["similarity"][0], neardup._similarity(plain(rows_[9]["shingles"], idf), plain(rows_[4]["shingles"], idf)), rtol=0, atol=1e-12)
    assert len(read) <= 2 * n


def test_first_shingles_of_texts_at_the_threshold_meet(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(1, 1 << 52, 60).astype(np.uint64)
    rows_, pairs = [], []
    for i in range(40):
        own = np.concatenate([common[: rng.integers(0, 60)], rng.integers(1, 1 << 52, 60).astype(np.uint64)])
        other = np.concatenate([own[rng.permutation(len(own))[: int(len(own) * 0.9)]], rng.integers(1, 1 << 52, 5).astype(np.uint64)])
        rows_ += [(2 * i, bytearray(np.sort(own).tobytes())), (2 * i + 1, bytearray(np.sort(np.repeat(other, 1 + (i % 2))).tobytes()))]
        pairs.append((2 * i, 2 * i + 1))
    idf = neardup.Idf(np.sort(common), np.full(60, 0.9, np.float32))
    parts: dict = {}
    for r in neardup._first_shingles(spark.createDataFrame(rows_, "v long, shingles binary"), idf).collect():
        parts.setdefault(r["v"], set()).add(r["shingle"])
    bags = {v: neardup._bag_of(bytes(raw), idf) for v, raw in rows_}
    near = [(x, y) for x in bags for y in bags if x < y and neardup._similarity(bags[x], bags[y]) >= neardup.THRESHOLD]
    assert len(near) >= 10 and all(parts[x] & parts[y] for x, y in near)
    # not the whole texts
    assert all(len(parts[v]) < 0.4 * len(bags[v][0]) for v in bags)


def test_near_duplicates_against_brute_force(spark, odd, empty, monkeypatch):
    texts = []
    for family in range(6):
        base = prose(1000 + family, 200).split(" ")
        for copy in range(6):
            rng = np.random.default_rng(family * 10 + copy)
            w = list(base)
            for at in rng.choice(len(w), copy, replace=False):
                w[at] = f"edit{family}{copy}{at}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[30], *(prose(5000 + i, 60) for i in range(10))]
    documents = spark.createDataFrame(rows(texts), SCHEMA)
    similarity = weighted_jaccard(texts, neardup.idf_table(documents))
    for small, block in ((32, 512), (1, 2)):  # pair by pair; in blocks and split by a further band
        monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents).collect()}
        parent = list(range(len(texts)))

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(texts)):
            for j in range(i):
                if similarity(i, j) >= 0.8:
                    parent[max(top(i), top(j))] = min(top(i), top(j))
        want = {i: top(i) for i in range(len(texts))}
        assert got == want
    assert neardup.classes(empty).count() == 0


def test_an_id_with_two_texts_is_two_documents(spark):
    for seed in range(2):
        first, second = prose(7000 + seed, 200), prose(8000 + seed, 200)
        texts = [first, second, f"{first} more", f"{second} more", prose(9000 + seed, 200)]
        documents = spark.createDataFrame(rows(texts, ids=[0, 0, 1, 2, 3]), SCHEMA)
        got = neardup.classes(documents).collect()
        assert sorted(r["class_id"] for r in got) == [1, 1, 2, 2, 3] and {r["doc_id"]: r["class_id"] for r in got if r["doc_id"]} == {1: 1, 2: 2, 3: 3}
        assert sorted(r["text"] for r in neardup.keep_one(documents).collect()) == sorted([first, second, texts[4]])


def test_negative_and_repeated_ids(spark):
    texts = [prose(1, 100), prose(2, 100), prose(3, 100), prose(3, 100) + " more"]
    documents = spark.createDataFrame(rows(texts, ids=[1, 1, 2, -5]), SCHEMA)
    got = neardup.classes(documents).collect()
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] != 1} == {2: -5, -5: -5}
    assert len({r["class_id"] for r in got}) == 3
    assert sorted(r["text"] for r in neardup.keep_one(documents).collect()) == sorted([texts[0], texts[1], texts[3]])


def test_document_frequencies_are_exact(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60 + i)) + (" one two three four five" if i % 3 == 0 else "") for i in range(300)]
    documents = spark.createDataFrame(rows(texts), SCHEMA)
    for bits in (17, 3):  # with cells that hold one shingle and hundreds
        idf = neardup.idf_table(documents, bits, 500)
        _, _, shingle, _ = neardup.bag(pa.array(["one two three four five"]))
        assert idf.frequent.tolist() == shingle.tolist() and np.allclose(idf.value, neardup.idf_of_share(np.array([1 / 3])))
        assert idf.of(np.array([5], np.uint64))[0] == 1


def test_near_copies_are_found(spark):
    """Recall of pairs at the threshold, against all pairs by plain five-word Jaccard similarity."""
    rng, texts = np.random.default_rng(9), []
    for family in range(60):
        base = prose(20_000 + family, 150 + family).split(" ")
        for _ in range(3):
            w = list(base)
            for at in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
                w[at] = f"other{rng.integers(1 << 30)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (WORD.findall(t) for t in texts)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(runs[i] & runs[j]) >= 0.82 * len(runs[i] | runs[j])]
    assert len(near) > 60 and np.mean([got[i] == got[j] for i, j in near]) >= 0.98
    far = [(i, j) for i in range(len(texts)) for j in range(i) if i // 3 != j // 3]
    assert not any(got[i] == got[j] for i, j in far)


def test_near_duplicates_of_odd_rows(spark, odd):
    found = neardup.classes(odd).collect()
    assert len(found) == odd.count()
    got = {r["doc_id"]: r["class_id"] for r in found}
    assert got[5] == got[6] == 5 and [got[i] for i in (0, 1, 2, 3, 4)] == [0, 1, 2, 3, 4] and got[None] not in range(13)
    kept = neardup.keep_one(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, None])


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    shingle = np.unique(rng.integers(0, 1 << 52, 400).astype(np.uint64))
    a, b = rng.choice([1.0, 1.7, 2.1], len(shingle)), rng.choice([0.0, 1.0, 1.7, 2.1], len(shingle))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits = 0
    for salt in range(40):
        s = textvec.mix(shingle + np.uint64(salt)) >> np.uint64(12)
        order = np.argsort(s)
        _, x = neardup.samples(np.zeros(len(s), int), s[order], a[order])
        keep = b[order] > 0
        _, y = neardup.samples(np.zeros(int(keep.sum()), int), s[order][keep], b[order][keep])
        hits += int((x == y).sum())
    n = 40 * neardup.BANDS * neardup.ROWS
    assert abs(hits / n - truth) < 4 * math.sqrt(truth * (1 - truth) / n)


def test_search_against_brute_force(spark, odd, empty, monkeypatch):
    texts = [prose(i, 30 + i % 50) for i in range(300)] + [prose(3, 33)] * 3 + ["", "the the the"]
    documents = spark.createDataFrame([*rows(texts), (None, prose(3, 33), "en", "a", 1, "k", 1, "s")], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 20 == 0] + [(900, "the edge"), (901, None), (902, ""), (903, "zzzzqq")], "query_id long, text string")
    bags = [collections.Counter(WORD.findall(t)) for t in [*texts, prose(3, 33)]]
    df = collections.Counter(w for b in bags for w in b)
    n = sum(bool(b) for b in bags)
    mean = sum(sum(b.values()) for b in bags) / n
    ids = [*range(len(texts)), None]

    def score(q, b):
        return sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in q if w in b)

    for probe, shard, together in ((10_000, 8192, 128), (20, 16, 3)):
        monkeypatch.setattr(search, "PROBE_LEAST", probe)
        monkeypatch.setattr(search, "FLOOR_ROW", 7)
        monkeypatch.setattr(search, "SHARD_DOCUMENTS", shard)
        monkeypatch.setattr(search, "TOGETHER", together)
        got = collections.defaultdict(list)
        for r in search.search(documents, asked, 7).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for r in asked.collect():
            q = set(WORD.findall(r["text"] or ""))
            want = sorted(((-score(q, b), i is None, i or 0) for i, b in zip(ids, bags, strict=True) if q & b.keys()))[:7]
            assert [x for x, _ in got[r["query_id"]]] == [None if w[1] else w[2] for w in want]
            assert np.allclose([s for _, s in got[r["query_id"]]], [-w[0] for w in want])
    assert search.search(empty, asked).count() == 0 and search.search(documents, asked.limit(0)).count() == 0
    assert search.search(odd, odd.selectExpr("doc_id as query_id", "text")).count() > 0


def test_search_skips_blocks_and_finds_the_same():
    """Documents about one of many things: once bounds are known, most blocks are skipped for a query."""
    rng = np.random.default_rng(3)
    texts = []
    for topic in range(40):
        own = [f"topic{topic}word{k}" for k in range(60)]
        texts += [" ".join([*rng.choice(own, 50), *rng.choice(["the", "of", "and", "to"], 30)]) for _ in range(64)]
    doc, term, times, size = search.term_bag(pa.array(texts))
    asked = [np.unique(term[doc == i]) for i in range(0, len(texts), 50)]
    q = search.QueryBlock(asked)
    at, pos, n = q.find(doc, term, times)
    df = np.bincount(pos, minlength=len(q.terms))
    q.idf, q.mean = np.log1p((len(texts) - df + 0.5) / (df + 0.5)), size.mean()
    shard = search.Shard(q, at, pos, n, size, np.arange(len(texts)))
    every = np.arange(len(texts))
    want = [search.best(every, shard.score(t, every), 10) for t in q.of]
    floor = np.array([s[-1] for _, s in want])
    got = dict(shard.candidates(q.of, floor, 10))
    for k, (ids, scores) in enumerate(want):
        live = got[k]
        assert (search.best(live, shard.score(q.of[k], live), 10)[0] == ids).all()
    assert shard.looked_into < 0.1 * shard.pairs


# 4 mixing, 7 fingerprints, 9 licenses


def test_mix_takes_what_targets_say(spark, odd, empty):
    texts = [prose(i, 40 + 13 * (i % 9)) for i in range(90)]
    documents = spark.createDataFrame(rows(texts, sources=["big"] * 60 + ["small"] * 20 + [None] * 10), SCHEMA)
    got = mixing.taken_words(documents).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(90))
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    size, taken, target = (collections.Counter() for _ in range(3))
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total = 1.5 * sum(size.values())
    weight = {"big": 3, "small": 1, None: 2}
    full: set = set()
    while True:  # reshare by weight until none is above twice its size
        left = total - sum(2 * size[s] for s in full)
        share = {s: left * w / sum(weight[x] for x in weight if x not in full) for s, w in weight.items() if s not in full}
        over = {s for s, v in share.items() if v > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2.0 * size[s] if s in full else share[s] for s in weight}
    assert all(math.isclose(want[s], target[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)
    assert sorted(map(tuple, mixing.taken_words(documents).drop("row").collect())) == sorted((tuple(r)[1:] for r in got))
    schedule, _, _ = mixing.mix(documents)
    slots = sorted({(r["slot"], r["source"]) for r in schedule.collect()}, key=lambda x: x[0])
    for at in (len(slots) // 4, len(slots) // 2):  # any start of the mix has nearly the final shares
        part = collections.Counter(s for _, s in slots[:at])
        whole = collections.Counter(s for _, s in slots)
        assert all(abs(part[s] - at * whole[s] / len(slots)) < 5 for s in whole)
    mixed = mixing.mixed_documents(documents)
    assert mixed.schema == documents.schema and mixed.count() > 90
    assert mixing.taken_words(odd).count() == odd.count() and mixing.mixed_documents(odd).schema == odd.schema
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_fingerprints_against_definition(spark, odd, empty, monkeypatch):
    for size in (1000, 2):  # one range, many ranges
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
        got = sorted(map(tuple, fingerprint.fingerprints(odd).collect()), key=str)
        order = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), hashlib.md5((r["text"] or "").encode()).hexdigest()))
        texts = [r["text"] or "" for r in order]
        leaves = lambda t: collections.Counter(hashlib.md5(p.encode()).hexdigest()[:12] for line in t.split("\n") for p in re.findall(r"[^.!?]{1,128}[.!?]*|[.!?]{1,128}", line))

        def near(a, b):
            x, y = leaves(a), leaves(b)
            return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x or y else 1.0

        want = []
        for i, r in enumerate(order):
            t, following = texts[i], texts[(i + 1) % len(texts)]
            edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
            want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, following)))
        assert sorted(((g[0], g[1], g[2], g[5], g[6]) for g in got), key=str) == sorted(want, key=str)
        name = {}
        for r in fingerprint.fingerprints(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
            assert name.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
        assert len(set(name.values())) == len(name)
    assert fingerprint.fingerprints(empty).count() == 0


def test_rows_without_an_id_and_of_one_id_are_split(spark):
    texts = [f"text {i} of many" for i in range(200)]
    documents = spark.createDataFrame([*((None, t) for t in texts), *((5, t) for t in texts), *enumerate(texts, 1000)], "doc_id long, text string")
    rows = documents.withColumn("hash", fingerprint.F.md5(documents["text"].cast("binary")))
    sizes = [r["count"] for r in rows.groupBy(fingerprint._ranges(rows).alias("part")).count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 402
    import unittest.mock

    with unittest.mock.patch.object(fingerprint, "RANGE_ROWS", 20):
        sizes = [r["count"] for r in rows.groupBy(fingerprint._ranges(rows).alias("part")).count().collect()]
        assert sum(sizes) == 600 and max(sizes) < 60
        order = sorted(documents.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), hashlib.md5(r["text"].encode()).hexdigest()))
        after = {(r["doc_id"], r["text"]): order[(i + 1) % len(order)]["text"] for i, r in enumerate(order)}
        assert all(after[(r["doc_id"], r["text"])] == r["next"] for r in fingerprint.with_next(documents).collect())


def test_edits_are_located(spark):
    before = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(60)))], "doc_id long, text string")
    after = spark.createDataFrame([(1, "\n".join("changed" if i == 17 else f"line {i}" for i in range(60)))], "doc_id long, text string")
    edits = {(r["paragraph"], r["change"]) for r in fingerprint.locate_edits(before, after).collect()}
    assert len(edits) == 2 and {c for _, c in edits} == {"removed", "added"}
    assert fingerprint.locate_edits(before, before).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_license_templates(spark, odd, empty):
    good, altered = MIT.format(who="the authors or copyright holders"), MIT.format(who="the authors").replace("merge, publish", "publish")
    texts = [f"# code\n{good}\n", altered, "see the Apache License, and the apache license; CC BY", "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "gnu general\npublic  license, mit license", None, "MIT licenses"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got[0]["labels"] == "MIT" and got[0]["score"] == 1 and got[0]["n_base"] == 0 and got[0]["spans"][0]["start"] == 1
    assert got[1]["labels"] == "" and got[1]["score"] == 0
    assert got[2]["base_labels"] == got[2]["labels"] == "apache,cc-by" and got[2]["n_base"] == 3 and (got[2]["first_word"], got[2]["last_word"]) == (2, 8)
    assert got[3]["labels"] == "Apache-2.0,apache"
    assert got[4]["base_labels"] == "gpl" and got[5]["base_labels"] == "gpl,mit" and got[5]["score"] == 0.5
    assert (got[6]["n_words"], got[6]["first_word"], got[6]["labels"]) == (0, None, "") and got[7]["n_base"] == 0
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def template_labels(text, one=None):
    """Labels of a text by the operator's own automata and identifiers, without Spark; by one template only where it is given."""
    by_opening = licenses.every_template() if one is None else licenses.compiled(one, {})
    w = textvec.Words(*textvec.utf8(pa.array([text])))
    key = licenses.pair_key(w.hash)
    spans, whole = [], []
    for i, k in enumerate(key.tolist()):
        for t in by_opening.get(k, ()):
            if used := t.accepts(w.hash[i:]):
                (whole if t.whole else spans).append({"label": t.label, "start": i, "end": i + used})
    found = {s["label"] for s in licenses.outside(spans, whole)}
    return found | ({x for _, _, labels in licenses.identified(text.encode()) for x in labels} if one is None else set())


def instance(parts, r, optional):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "any":
            out += [f"name{r.randrange(50)}" for _ in range(r.randint(0, p[1]))]
        elif optional:
            out += instance(p[1], r, optional)
    return out


def test_each_template_gives_its_label_alone():
    r = random.Random(4)
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            wording, rest = licenses.split(text)
            for optional in (False, True):
                assert template_labels(" ".join(["zz", *instance(wording, r, optional), "zz"])) == {label}, text
            if rest:
                assert label not in template_labels(" ".join(instance(rest, r, True)))
            changed = instance(wording, r, True)
            fixed = [k for k, w in enumerate(changed) if not w.startswith("name")]
            changed[fixed[len(fixed) // 2]] = "altered"
            assert not template_labels(" ".join(changed), {label: [text]}), text


def test_each_whole_licence_gives_its_label_alone():
    r = random.Random(5)
    for label, text in licenses.WHOLE.items():
        parts = licenses.parse(text)
        for optional in (False, True):
            assert template_labels(" ".join(["zz", *instance(parts, r, optional), "zz"])) == {label}
        words_ = instance(parts, r, False)
        words_[len(words_) // 2] = "altered"
        assert not template_labels(" ".join(words_), {label: [text]})


def test_licences_as_published():
    """Texts that come with this machine; each gives its one label."""
    import pathlib

    want = {"GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"}
    for name in ("Apache-2.0", "CC0-1.0", "MPL-1.1", "MPL-2.0"):
        want[name] = name
    want |= {name: f"{name}-only" for name in ("GFDL-1.2", "GFDL-1.3")}
    for name, label in want.items():
        file = pathlib.Path("/usr/share/common-licenses") / name
        if file.exists():
            assert template_labels(file.read_text(errors="replace")) == {label}, name


def test_identifier_expressions():
    for text, want in {
        "SPDX-License-Identifier: GPL-3.0+": {"GPL-3.0-or-later"},
        "// SPDX-License-Identifier: Apache-2.0 OR MIT */": {"Apache-2.0", "MIT"},
        "spdx-license-identifier: (LGPL-2.1 AND BSD-3-Clause) WITH unknown-exception\nMPL-2.0": {"LGPL-2.1-only", "BSD-3-Clause"},
        "SPDX-License-Identifier: none-known": set(),
    }.items():
        assert template_labels(text) == want, text


def test_license_neighbours():
    for text, want in {
        "GNU General Public License version 3 or any later version": {"GPL-3.0-or-later"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0-only"},
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": {"LGPL-2.1-or-later"},
        "GNU Affero General Public License v3.0": {"AGPL-3.0-only"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0-or-later"},
        "SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0-only"},
        "SPDX-License-Identifier: MIT-0": {"MIT-0"},
        "SPDX-License-Identifier: BSD-3-Clause": {"BSD-3-Clause"},
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
        "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": {"CC-BY-NC-SA-4.0"},
        "the apache license": set(),
    }.items():
        assert template_labels(text) == want, text


def test_licenses_as_packages_ship_them():
    """Texts that come with Spark's own package."""
    import pathlib

    import pyspark

    folder = pathlib.Path(pyspark.__file__).parent / "licenses"
    for name, want in {"AnchorJS": "MIT", "CC0": "CC0-1.0", "bootstrap": "MIT", "cloudpickle": "BSD-3-Clause", "py4j": "BSD-3-Clause", "d3.min.js": "ISC", "json-formatter": "Apache-2.0", "loose-version": "0BSD", "modernizr": "MIT"}.items():
        file = folder / f"LICENSE-{name}.txt"
        if file.exists():
            assert template_labels(file.read_text(errors="replace")) == {want}, name


def test_automata_accept_what_their_expressions_accept():
    rng = np.random.default_rng(3)
    template = "one two <<beginOptional>> three <<beginOptional>> four <<endOptional>> <<endOptional>> five <<var;max=2>> six"
    parts = licenses.parse(template)
    machine, pattern = licenses.compile_template("t", parts), re.compile(licenses.parts_regex(parts))
    vocabulary = "one two three four five six".split()
    for _ in range(3000):
        w = ["one", "two", *rng.choice(vocabulary, rng.integers(0, 7))]
        hashes = np.array([textvec.word_hash(x) for x in w], np.uint64)
        assert bool(machine.accepts(hashes)) == bool(pattern.match(" " + " ".join(w) + " "))


def test_quality_features_against_plain_counts():
    texts = [t for t in odd_texts() if t and len(t) < 20_000] + ["One two two THREE!\nfour, 55 five\nfour, 55 five\n", "a | b # c$ d"]
    got = quality.text_features(pa.array(texts))
    at = {name: k for k, name in enumerate(quality.FEATURES)}
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        w = WORD.findall(t.lower())
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        lines = [x for x in (tuple(sorted(WORD.findall(line.lower()))) for line in t.split("\n")) if x]
        n, k = max(len(raw), 1), max(len(w), 1)
        want = {
            "log_chars": math.log1p(len(raw)), "log_words": math.log1p(len(w)), "mean_word": sum(len(x.encode()) for x in w) / k,
            "upper": sum(65 <= b <= 90 for b in raw) / n, "digit": sum(48 <= b <= 57 for b in raw) / n, "pipe": raw.count(b"|") / n, "non_ascii": sum(b >= 128 for b in raw) / n,
            "short_words": sum(len(x.encode()) <= 3 for x in w) / k, "long_words": sum(len(x.encode()) >= 12 for x in w) / k, "one_letter": sum(len(x.encode()) == 1 for x in w) / k,
            "repeat_word": sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, "distinct_words": len(set(w)) / k, "top_word": max(collections.Counter(w).values(), default=0) / k,
            "distinct_shingles": len(set(runs)) / max(len(runs), 1), "line_words": len(w) / max(len(lines), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1),
        }
        assert all(math.isclose(row[at[f]], v, rel_tol=1e-9, abs_tol=1e-12) for f, v in want.items()), (t[:40], {f: (row[at[f]], v) for f, v in want.items()})


def test_a_pair_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=12), rng.random(12) + 0.5
        gain, cut = quality._split(g, h, 1.0, 0.1)
        of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
        every = {k: of(0, k) + of(k, 12) - of(0, 12) for k in range(1, 12)}
        assert math.isclose(gain, max(every.values())) and math.isclose(every[cut], gain)
