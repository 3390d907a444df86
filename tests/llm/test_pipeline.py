"""The pipeline's stages on planted cases and odd rows."""

import random

import numpy as np

import corpus_pipeline
from lexigrid.llm import neardup, simhash
from tests.llm.test_operators import prose


def test_planted_cases(spark, folder, docs):
    rng = random.Random(21)
    clean = [prose(rng, 90) for _ in range(12)]
    item = prose(rng, 30)
    texts = [*clean, clean[0], clean[1] + " extra", "### " * 100, prose(rng, 5), f"{prose(rng, 60)}\n{item}\n{prose(rng, 60)}"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = corpus_pipeline.run(spark, folder(documents=docs(texts), benchmark=bench)).collect()
    ids = {r["doc_id"] for r in found}
    assert 12 not in ids and not ids & {14, 15, 16} and ids <= set(range(14))
    assert all(0 < r["taken"] <= 2 * len(r["text"].split()) for r in found)


def test_stages_keep_columns_and_bear_odd_rows(spark, odd, empty, folder):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = folder(benchmark=bench)
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, path)
            out.collect()
            assert out.columns[: len(df.columns)] == df.columns, name


def test_near_copies_go(spark, docs):
    rng = random.Random(22)
    texts, want = [], set()
    for k in range(40):
        words = prose(rng, 120).split()
        want.add(len(texts))
        texts.append(" ".join(words))
        copy = list(words)
        for at in rng.sample(range(6, 110), 1 + k % 2):  # a word changed costs five of 116 shingles
            copy[at] = "changed"
        texts.append(" ".join(copy))
        half = words[:60] + prose(rng, 60).split()
        want.add(len(texts))
        texts.append(" ".join(half))
    left = corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()
    assert {r["doc_id"] for r in left} == want


def test_near_copies_in_several_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_BYTES", 6000)
    rng = random.Random(23)
    words = prose(rng, 120).split()
    texts = [" ".join(words[:at] + [f"w{at}"] + words[at + 1 :]) for at in range(0, 120, 3)] + [prose(rng, 120)]
    left = corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()
    assert {r["doc_id"] for r in left} == {0, 40}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_come_from_fingerprints(spark, docs, monkeypatch):
    """The stage is operator 1's method, wider: its candidates are pairs of near fingerprints, all of them."""
    assert neardup.fingerprint is simhash.fingerprint
    rng = random.Random(24)
    texts = []
    for _ in range(30):
        words = prose(rng, 150).split()
        texts.append(words)
        for changes in (1, 2, 3):
            texts.append([f"z{k}" if k in set(rng.sample(range(150), changes)) else w for k, w in enumerate(words)])
    sets = [neardup.shingles(neardup.word_hashes(" ".join(w).encode())) for w in texts]
    prints = [neardup.prints(neardup.shingles(neardup.word_hashes(" ".join(w).encode()), 2)) for w in texts]
    keys = range(1000, 1000 + len(texts))
    tile = np.array([keys, *zip(*prints, strict=True)], np.uint64)
    close = {(i, j) for i in range(len(texts)) for j in range(i) if bool(neardup.near(*(np.array([x], np.uint64) for x in prints[i]), *map(np.uint64, prints[j]))[0])}
    assert {(i, j) for i in range(len(texts)) for j in range(i) if neardup.similar(sets[i], sets[j])} <= close
    want = groups(range(len(texts)), close)
    u, v = neardup.compare_prints(tile)
    assert groups(range(len(texts)), zip(u.tolist(), v.tolist(), strict=True), 1000) == want
    monkeypatch.setattr(neardup, "AT_ONCE", 300)
    monkeypatch.setattr(neardup, "TILE_ROWS", 25)
    rows = [(k, *(x - 2**64 if x >= 2**63 else x for x in p), neardup.band(len(s))) for k, p, s in zip(keys, prints, sets, strict=True)]
    found = neardup.candidate_links(spark.createDataFrame(rows, "key long, first long, second long, band long")).collect()
    assert groups(range(len(texts)), [(r["u"], r["v"]) for r in found], 1000) == want


def groups(nodes, links, shift=0):
    root = {n: n for n in nodes}
    for u, v in links:
        a, b = root[u - shift], root[v - shift]
        root = {n: min(a, b) if r in (a, b) else r for n, r in root.items()}
    return root


def test_bands_hold_similar_sizes():
    assert all(neardup.band(n * 5 // 4) - neardup.band(n) in (0, 1) for n in range(1, 30_000))
