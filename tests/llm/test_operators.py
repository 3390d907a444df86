"""The corpus operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrid.llm import decontam, langid, lines, mixing, pii, quality, secrets, simhash, substring, warc
from lexigrid.llm.common import connected_components


FULL = {"op1": simhash.op1_simhash, "op2": substring.op2_substring_dedup, "op3": quality.op3_quality, "op4": decontam.op4_decontamination, "op5": pii.op5_pii, "op6": lines.op6_line_dedup, "op7": langid.op7_langid, "op8": secrets.op8_secrets, "op10": mixing.op10_mixing}


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "What is the total cost of 12 apples at 3 euros each for our friend Anna today"), (2, None), (None, "x")], "item_id long, text string")


@pytest.mark.parametrize("name", list(FULL))
def test_odd_rows(spark, folder, odd, bench, name):
    rows = FULL[name](spark, folder(documents=odd, benchmark=bench)).collect()
    counts = {"op2": None, "op4": 0, "op6": None, "op1": 10, "op3": 10, "op5": 10, "op7": 10, "op8": 10, "op10": 10}[name]
    assert counts is None or len(rows) == counts


@pytest.mark.parametrize("name", list(FULL))
def test_empty_table(spark, folder, empty, bench, name):
    assert FULL[name](spark, folder(documents=empty, benchmark=bench)).collect() == []


def bits_of(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash(spark, folder, docs):
    rng = random.Random(1)
    texts = ["", None, "one", "two words", "ÄÖ Foo\x1cbar x"]
    for _ in range(40):
        t = prose(rng, 60)
        texts += [t, t.upper(), t + " end", t.replace("a", "e", 1)]
    got = {r["doc_id"]: r for r in simhash.op1_simhash(spark, folder(documents=docs(texts))).collect()}
    prints = [bits_of(t or "") for t in texts]
    want = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == want


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 60, np.uint64)
    values = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) for _ in range(8))]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    nodes = connected_components(simhash.near_links(df, 2, tile_rows=4)).collect()
    got = {r["node"]: r["component"] for r in nodes}
    signed = values.view(np.int64).tolist()
    want = components(len(values), lambda i, j: int(values[i] ^ values[j]).bit_count() <= 2)
    groups = {}
    for k, w in enumerate(want):
        groups.setdefault(w, set()).add(signed[k])
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n, c in got.items() if c == root) for root in set(got.values())}


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "u long, v long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_near_dedup_keeps_the_first(spark, docs):
    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 80)
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs([a, b, a, a])).collect()) == [0, 1]


def test_substring(spark, folder, docs):
    rng = random.Random(5)
    shared = prose(rng, 52)
    texts = [prose(rng, 80) for _ in range(30)]
    for k in (3, 8, 20):
        texts[k] = f"{prose(rng, rng.randint(5, 40))} {shared} {prose(rng, 30)}"
    texts += ["Licensed under the Apache License.\n" + prose(rng, 60) for _ in range(3)]
    rows = {r["doc_id"]: r for r in substring.op2_substring_dedup(spark, folder(documents=docs(texts))).collect()}
    assert set(rows) == {3, 8, 20} and all(r["first_doc"] == 3 for r in rows.values())
    for k, r in rows.items():
        start, end = map(int, r["spans"].split(":"))
        assert texts[k].encode()[start:end].decode() in shared


def test_chunks_resist_insertions():
    rng = random.Random(6)
    text = prose(rng, 3000).encode()

    def cut(t):
        ends = [0, *substring.boundaries(np.frombuffer(t, np.uint8), np.array([0])).tolist()]
        return {t[x:y] for x, y in zip(ends, ends[1:], strict=False)}

    before, after = cut(text), cut(text[:5000] + b"inserted" + text[5000:])
    assert len(before - after) <= 4 and len(before) > 300


def test_repeat_words(spark, docs):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [prose(rng, 200)]

    def brute(t):
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})

    from lexigrid.llm.common import words_of

    got = docs(texts).select("doc_id", quality.repeat_words(words_of(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {k: brute(t) for k, t in enumerate(texts)}


def test_quality_order_changes_no_verdict(spark, docs):
    rng = random.Random(8)
    texts = [prose(rng, 100), "### " * 80, prose(rng, 100).upper(), "a b c " * 60, prose(rng, 10), "same line here\n" * 50]
    df = docs(texts)
    by = {}
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        rows = df.where(quality.verdict(F.col("text"), order).isNull()).collect()
        by[len(by)] = sorted(r["doc_id"] for r in rows)
    assert by[0] == by[1] == [0]
    assert sorted(r["doc_id"] for r in quality.quality_filter(df).collect()) == [0]
    assert {r.name for r in quality.plan_order(df)} == {r.name for r in quality.RULES}


def test_decontamination(spark, folder, docs, bench):
    rng = random.Random(9)
    item = "What is the total cost of 12 apples at 3 euros each for our friend Anna today"
    same = item.replace("12", "40").replace("3 ", "7 ").replace("Anna", "Otto")
    mixed = "total of 12 and 12 makes 24 in the long sum that we wrote down here for you all"
    items = spark.createDataFrame([(1, item), (2, mixed)], "item_id long, text string")
    broken = mixed.replace("12 and 12", "5 and 6")
    texts = [f"{prose(rng, 40)} {t} {prose(rng, 40)}" for t in (item, same, prose(rng, 16), mixed, broken)]
    for most in (decontam.MOST_HASHES, 0):  # with and without the broadcast prefilter
        decontam.MOST_HASHES, kept = most, decontam.MOST_HASHES
        rows = {r["doc_id"]: r for r in decontam.op4_decontamination(spark, folder(documents=docs(texts), benchmark=items)).collect()}
        decontam.MOST_HASHES = kept
        assert set(rows) == {0, 1, 3} and rows[0]["verbatim"] and not rows[1]["verbatim"] and rows[3]["items"] == "2"
    left = decontam.drop_contaminated(docs(texts), items).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 4]


def test_slots_are_read_by_occurrence(spark, docs):
    rng = random.Random(24)
    item = "Anna bought 12 red apples and gave 3 of them to her old friend who lives near the green park by the river"
    copies = [item.replace("12", a).replace("3 ", b + " ") for a, b in (("40", "7"), ("50", "6"))]
    grown = [c.replace("old friend", "old and dear friend") for c in copies]
    equal = item.replace("12", "4").replace("3 ", "4 ")
    texts = [f"{prose(rng, 30)} {t} {prose(rng, 30)}" for t in (" ".join(copies), " ".join(grown), equal, prose(rng, 20))]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.contaminated(docs(texts), items).collect()}
    assert set(found) == {0, 1, 2} and all(r["consistent"] and not r["verbatim"] for r in found.values())


def test_short_and_slotted_items_are_found_in_longer_texts(spark, docs, monkeypatch):
    rng = random.Random(25)
    items = ["zyx", "blue whale", "blue whale song", "who has 7 kites", "3 + 4 = 7", "Ask Anna Otto 5 6 7 8 Berta"]
    texts = [f"{prose(rng, 30)} {t} {prose(rng, 30)}" for t in [*items, "3 + 4 = 8", "who has 9 kites"]] + [prose(rng, 60)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (decontam.MOST_HASHES, 0):
        monkeypatch.setattr(decontam, "MOST_HASHES", most)
        found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.contaminated(docs(texts), benchmark).where("consistent").collect()}
        assert found == {(k, k): True for k in range(6)} | {(2, 1): True, (7, 3): False}


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(t):
    number = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", EMAIL, lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
    )
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m))


def base_secrets(t):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    kinds = (
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m)))


@pytest.mark.parametrize(("op", "base", "pieces"), [
    (pii.op5_pii, base_pii, ["a@b.co", "x_y@z.w-1.q", "_n@m.k@l.o", "1.2.3.4", "001.2.3.400", "1.2.3.4.5.6.7.8", "4465758382889437", "4465 7583-8288 9437", "+1 (555) 010-9999", "+49.30.1234567", "é", " ", ",", "12", "-", "."]),
    (secrets.op8_secrets, base_secrets, ["password", "Token = ", "api_key:", "'", '"', "secret=", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0f" * 13, "ſecret=", "é", " ", "="]),
])
def test_base_spans(spark, folder, docs, op, base, pieces):
    rng = random.Random(10)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for r in op(spark, folder(documents=docs(texts))).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[r["doc_id"]], want, r["spans"])


def test_disclosing_terms(spark, folder, docs):
    rng = random.Random(11)
    texts = [prose(rng, 40) for _ in range(60)]
    for k in range(5):
        texts[k] = f"{prose(rng, 9)} zorblax {prose(rng, 1)} ann@corp.example {prose(rng, 9)}"
    rows = {r["doc_id"]: r for r in pii.op5_pii(spark, folder(documents=docs(texts))).collect()}
    for k in range(5):
        at = texts[k].index("zorblax")
        assert f"term:{at}:{at + 7}" in rows[k]["spans"]
    assert not any("term" in rows[k]["spans"] for k in range(5, 60))
    spans = pii.pii_spans(docs(texts)).where("doc_id = 0")
    clean = spans.join(docs(texts), "doc_id").select(pii.sanitise(F.col("text"), {k: F.col(k) for k in (*pii.KINDS, "term")})).first()[0]
    assert "zorblax" not in clean and "[EMAIL]" in clean and "@" not in clean


def test_random_tokens(spark, folder, docs):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(20)]
    made = ["Aa1" * 20, "Version1Version1Version1Version1", "Qz9" * 18] * 3
    texts = [f"see {t} there" for t in found + made] + [prose(rng, 50)]
    rows = {r["doc_id"]: r["spans"] for r in secrets.op8_secrets(spark, folder(documents=docs(texts))).collect()}
    hits = [k for k in rows if rows[k]]
    assert len([k for k in hits if k < 20]) >= 18 and not [k for k in hits if k >= 20]
    assert rows[hits[0]] == f"random:4:{4 + 48}"
    assert "[SECRET]" in docs(texts).where("doc_id = 0").select(secrets.redact(F.col("text"), F.array(F.struct(F.lit(4).cast("long").alias("start"), F.lit(52).cast("long").alias("end"))))).first()[0]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def changed(rng, t, letters):
    t = list(t)
    for _ in range(rng.randint(0, 3)):
        k = rng.randint(0, len(t))
        t[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
    return "".join(t)


def test_banded_distance():
    rng = random.Random(13)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        b = changed(rng, a, "ab")
        for r in (1, 2, 3):
            assert lines.within(a, b, r) == (edit_distance(a, b) <= r), (a, b, r)


@pytest.mark.parametrize("bucket", [lines.BUCKET, 2])
def test_line_dedup(spark, docs, monkeypatch, bucket):
    rng = random.Random(14)
    seeds = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 40))).strip() for _ in range(12)]
    texts = ["\n".join(changed(rng, rng.choice(seeds), "abé") for _ in range(4)) + "\n  \n" + prose(rng, 6) for _ in range(40)]
    if bucket == 2:  # large buckets, in tiles of a few lines; the workers hold the code by value
        monkeypatch.setattr(lines, "TILE", 3)
    first, places = {}, []
    for k, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                places.append((k, n, line.strip()))
                first.setdefault(line.strip(), None)
    names = list(first)
    root = components(len(names), lambda i, j: min(len(names[i]), len(names[j])) >= 24 and edit_distance(names[i], names[j]) <= 2)
    seen, want = set(), set()
    for k, n, line in places:
        c = root[names.index(line)]
        if c in seen:
            want.add((k, n))
        seen.add(c)
    got = {(r["doc_id"], r["at"]) for r in lines.duplicate_lines(docs(texts)).where("duplicate").collect()}
    assert got == want
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs(texts)).collect()}
    for k, t in enumerate(texts):
        kept = [line for n, line in enumerate(t.split("\n")) if (k, n) not in want]
        if any(line.strip() for line in kept):
            assert out[k]["text"] == "\n".join(kept) and out[k]["n_chars"] == len(out[k]["text"])
        else:
            assert k not in out


def test_large_buckets_meet_in_tiles(spark, docs):
    rng = random.Random(15)
    base = "the same long line of text with a number at its end "
    texts = [base + f"{k:03d}" for k in range(130)]
    got = lines.duplicate_lines(docs(texts)).where("duplicate").count()
    assert got == 129, rng


def _peak(run, batch):
    """MB that Python takes at most while the function goes through the batch, and the rows it sends."""
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_line_workers_hold_little_whatever_the_document_and_batch():
    line = "{:06d} a line of a very long document"
    text = "\n".join(map(line.format, range(40_000)))
    peak, rows = _peak(lines._key_batches(2, 24), pa.RecordBatch.from_arrays([pa.array([text, None, ""])], ["text"]))
    assert rows == 40_000 * len(lines.layout(len(line.format(0)), 2, 24)) and peak < 16
    kind = pa.list_(pa.struct([("line", pa.int64()), ("text", pa.string())]))
    a, b = ([[{"line": 10_000 * k + side + j, "text": f"{k} {'ab'[side // 10]} {'xyz'[j] * 30}"} for j in range(3)] for k in range(6_000)] for side in (0, 10))
    batch = pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
    del a, b
    peak, rows = _peak(lines._tile_batches(2), batch)
    assert rows == 18_000 and peak < 4


def test_language(spark, folder, docs):
    rng = random.Random(16)
    sounds = {"aa": "kstp", "bb": "lmnr", "cc": "dgbv"}
    texts, langs = [], []
    for k in range(300):
        lang = sorted(sounds)[k % 3]
        texts.append(" ".join("".join(rng.choice(sounds[lang]) + rng.choice("aeiou") for _ in range(3)) for _ in range(25)))
        langs.append(lang)
    texts += ["12 34", None]
    langs += ["aa", None]
    rows = {r["doc_id"]: r for r in langid.op7_langid(spark, folder(documents=docs(texts, langs))).collect()}
    import zlib

    held = [k for k in range(302) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sorted(k for k in rows if rows[k]["held_out"]) == held
    scored = [k for k in held if k < 300]
    assert sum(rows[k]["lang_pred"] == langs[k] for k in scored) / len(scored) >= 0.95
    assert rows[300]["lang_pred"] == rows[301]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in rows.values())


def test_warc_round_trip(spark, folder, tmp_path):
    big = "<p>" + "é" * 300
    rows = [(5, "http://a.example/x y\r\nz", big), (3, None, big), (9, "u", big), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (None, "u", big), (4, "u", "x" * 700_000), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(repr, map(tuple, warc.op9_warc(spark, folder(pages=pages)).collect())))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = 3 if html == big and page != 3 else None
        want.append(repr((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers)))
    assert got == sorted(want)
    index = warc.write_warc(pages, f"file://{tmp_path}/w")
    place = index.where("record_id = '7'").first()
    assert warc.read_record(place["bundle"], place["frame"], place["offset"], place["length"])["payload"] == b"short"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.op9_warc(spark, folder(pages=none)).collect() == []


@pytest.mark.parametrize("rows_per_bucket", [mixing.BUCKET_ROWS, 3])
def test_mixing(spark, folder, docs, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_per_bucket)
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(90)]
    sources = [rng.choice(["b", "a", "z", None, "é"]) for _ in texts]
    df = docs(texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing.op10_mixing(spark, folder(documents=df)).collect()}
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (budget - sum(2 * sizes[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        open_ -= full
    for s in order:
        target[s] = level * weight[s] if s in open_ else 2.0 * sizes[s]
    taken = dict.fromkeys(order, 0)
    for k, s in enumerate(sources):
        r = rows[k]
        assert r["size"] == len(texts[k].split()) and r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(target[s] - 1 <= taken[s] <= target[s] + 1e-6 for s in order)
    mix = mixing.mix_documents(df).collect()
    assert {r["doc_id"]: r["taken"] for r in mix} == {k: r["taken"] for k, r in rows.items() if r["taken"]}


def test_lines_of_rows_that_share_an_id_or_have_none(spark, docs):
    rows = [(1, "license\nbody"), (None, "alpha\nbravo"), (None, "license\ncharlie"), (2, "delta\nlicense"), (2, "echo\nalpha\nfoxtrot"), (None, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 9, r["text"]) for r in lines.dedup_lines(df).collect())
    assert got == [(1, "license\nbody"), (2, "delta"), (2, "echo\nalpha\nfoxtrot"), (9, "bravo"), (9, "charlie")]
    marked = lines.duplicate_lines(df)
    assert marked.count() == 12 and marked.where("duplicate").count() == 4
    twice = lines.dedup_lines(df.union(df))
    assert sorted((r["doc_id"] or 9, r["text"]) for r in twice.collect()) == got


def test_clashing_columns_pass_through(spark, docs):
    rng = random.Random(30)
    plain = docs([prose(rng, 60) for _ in range(5)])
    names = ["taken", "n", "row", "_Row", "Flags", "any", "left", "_found", "_KEEP", "_Id", "place", "bucket", "KEY", "component_id"]
    df = plain.selectExpr("*", *(f"concat('own', doc_id) as {name}" for name in names))
    item = spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string")
    for stage in (lines.dedup_lines, simhash.near_dedup, lambda d: decontam.drop_contaminated(d, item), mixing.mix_documents, quality.quality_filter):
        out = stage(df)
        rows = out.collect()
        assert rows and all(r[5 + k] == f"own{r['doc_id']}" for r in rows for k in range(len(names)))
    mixed = mixing.mix_documents(plain.selectExpr("*", "1 as TAKEN", "2 as taken_0"))
    assert mixed.columns[5:] == ["taken_1", "taken_0", "taken"] and {r[5:7] for r in mixed.collect()} == {(1, 2)}


def test_mixing_rows_without_id(spark):
    rows = [(None, "a b c d", "s"), (None, "e f g h", "s"), (None, "e f g h", "s"), (3, "i j k l", "t"), (3, "m n", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_documents(df).collect()
    assert all(r["taken"] <= 2 * len(r["text"].split()) for r in mix) and abs(sum(r["taken"] for r in mix) - 27) <= 2


@pytest.mark.parametrize("blocks", [4, 8, 16])
def test_every_block_width_finds_all_links(spark, blocks):
    rng = np.random.default_rng(31)
    seeds = rng.integers(0, 2**63, 150, np.uint64)
    twins = np.array([int(s) ^ 1 << int(a) ^ 1 << int(b) for s, (a, b) in zip(seeds, (rng.choice(64, 2, replace=False) for _ in seeds), strict=True)], np.uint64)
    df = spark.createDataFrame([(int(v),) for v in np.unique(np.concatenate([seeds, twins])).view(np.int64)], "fp long")
    links = {frozenset((r["u"], r["v"])) for r in simhash.near_links(df, 2, blocks=blocks).collect()}
    assert links == {frozenset(map(int, np.array(p, np.uint64).view(np.int64))) for p in zip(seeds, twins, strict=True)}


def test_repeat_words_where_upper_bits_collide(spark):
    from lexigrid.llm.common import words_of

    word = lambda k: F.concat(F.lit("w"), F.xxhash64("id", F.lit(k)).cast("string"))
    windows = spark.range(0, 600_000, 1, 4).select(F.array(word(1), word(2), word(3)).alias("w"))
    zipped = F.get(F.transform(F.arrays_zip(*(F.slice("w", k, 1) for k in (1, 2, 3))), lambda x: F.xxhash64(x)), 0)
    pairs = windows.select("w", F.shiftright(zipped, quality.PLACE).alias("upper")).groupBy("upper").agg(F.collect_list("w").alias("ws")).where("size(ws) > 1").collect()
    assert pairs
    texts = []
    for k, r in enumerate(pairs):
        a, b = (" ".join(w) for w in r["ws"][:2])
        texts.append(f"{a} x{k} {b} y{k} {a} z{k} {b}")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r[0] for r in df.select(quality.repeat_words(words_of(F.col("text")))).collect()} == {12}


def test_quality_order_is_the_same_at_each_call(spark, docs):
    rng = random.Random(32)
    df = docs([prose(rng, rng.randint(5, 150)) for _ in range(80)] + ["### " * 80] * 5)
    assert len({tuple(r.name for r in quality.plan_order(df)) for _ in range(3)}) == 1


def test_matches_of_long_texts(spark):
    from lexigrid.llm.spans import apart, matches

    n = 200_000
    df = spark.createDataFrame([("12 " * n,)], "t string").select(matches(F.col("t"), "[0-9]+").alias("m"))
    assert df.select(F.size("m"), F.get("m", n - 1)["start"]).first()[:] == (n, 3 * n - 3)
    rng = random.Random(33)
    cut = lambda: sorted(rng.sample(range(60), 8))
    rows = [([(a[k], a[k + 1], "v") for k in range(0, 8, 2)], [(b[k], b[k + 1], "w") for k in range(0, rng.choice([0, 4, 8]), 2)]) for a, b in ((cut(), cut()) for _ in range(80))]
    span = "array<struct<start:bigint,end:bigint,val:string>>"
    for r in spark.createDataFrame(rows, f"a {span}, b {span}").select("a", "b", apart(F.col("a"), F.col("b")).alias("c")).collect():
        assert r["c"] == [x for x in r["a"] if not any(y["start"] < x["end"] and y["end"] > x["start"] for y in r["b"])]


def test_terms_against_brute_force(spark, docs):
    import math

    rng = random.Random(34)
    people = [f"p{k}@x.example" for k in range(4)]
    names = ["zorblax", "quimbly", "ordinary"]
    texts = []
    for k in range(80):
        extra = [rng.choice(people)] * (k % 3 == 0) + [n for n in names if rng.random() < (0.9 if n == "ordinary" else 0.0)]
        if extra and extra[0] == people[0]:
            extra.append("zorblax")
        if extra and extra[0] == people[1]:
            extra.append("Quimbly")
        words = prose(rng, 20).split() + extra
        rng.shuffle(words)
        texts.append(" ".join(words))
    tokens = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(EMAIL, " ", t))} | {w for w in ("example",) if "@" in t} for t in texts]
    held = {p: [k for k, t in enumerate(texts) if p in t] for p in people}
    want = set()
    for p, ks in held.items():
        for term in set().union(*(tokens[k] for k in ks)) - {"example"}:
            both, df = sum(term in tokens[k] for k in ks), sum(term in t for t in tokens)
            if both >= 3 and math.log2(80 * both / (df * len(ks))) >= 0.9 * math.log2(80 / len(ks)):
                want |= {(k, m.start(), m.end()) for k in ks for m in re.finditer(r"[^\W\d_]+", texts[k]) if m[0].lower() == term}
    got = {(r["doc_id"], t["start"], t["end"]) for r in pii.pii_spans(docs(texts)).collect() for t in r["term"]}
    assert got == want and want


def test_terms_with_and_without_broadcast(spark, docs):
    rng = random.Random(36)
    texts = [" ".join([*prose(rng, 30).split(), *(["zorblax", f"p{k % 2}@x.example"] if k % 4 == 0 else [])]) for k in range(40)]
    terms = lambda: sorted((r["doc_id"], t["start"], t["end"]) for r in pii.pii_spans(docs(texts)).collect() for t in r["term"])
    small = terms()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert terms() == small and len(small) >= 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_few_made_tokens_are_reported(spark):
    rng = random.Random(35)
    words = "apple river stone cloud green bright silver mountain winter summer yellow forest garden window bridge castle".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = {"_".join(rng.choice(words) for _ in range(4)) + str(rng.randint(0, 9999)) for _ in range(3000)}
    drawn = {"".join(rng.choice(letters) for _ in range(24)) for _ in range(30)}
    found = {r[0] for r in secrets.random_tokens(spark.createDataFrame([(t,) for t in made | drawn], "val string"), 0.05).collect()}
    assert len(found & drawn) >= 27 and len(found - drawn) <= 0.05 * len(found)


@pytest.mark.parametrize(("letters", "size"), [("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32), ("0123456789", 40), ("abcdefghijklmnopqrstuvwxyz0123456789-_", 40)])
def test_every_alphabet_is_tested(spark, letters, size):
    rng = random.Random(36)
    drawn = {"".join(rng.choice(letters) for _ in range(size)) for _ in range(60)}
    found = secrets.random_tokens(spark.createDataFrame([(t,) for t in drawn], "val string"), 0.05).count()
    assert found >= 54


def test_language_without_letters_many_languages_and_long_texts(spark, docs, monkeypatch):
    rng = random.Random(37)
    names, texts, langs = [f"l{k:02d}" for k in range(70)], [], []
    for k, name in enumerate(names):
        own = [f"{a}{b}{c}" for a, b, c in zip(rng.sample("bcdfghklmnpqrstvwxz", 12), rng.choices("aeiouy", k=12), rng.sample("bcdfghklmnpqrstvwxz", 12), strict=True)]
        for _ in range(4):
            texts.append(" ".join(rng.choice(own) + rng.choice(own) for _ in range(40)))
            langs.append(name)
    df = docs(texts, langs)
    got, table = langid.train(df.select("lang", "text"))
    assert got == names and table.shape == (langid.SLOTS, 2)
    more = docs([*texts, "\u00b2 \u00bd \u2460", "x\u00b2"]).withColumn("held_out", F.lit(True))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(more, got, table).collect()}
    assert sum(found[k] == langs[k] for k in range(len(texts))) >= 0.97 * len(texts)
    assert found[len(texts)] == "und" and found[len(texts) + 1] != "und"
    whole = [np.sort(np.concatenate([h for h, _ in langid.grams([t])])) for t in texts[:3]]
    monkeypatch.setattr(langid, "PIECE", 64)
    for t, want in zip(texts[:3], whole, strict=True):
        assert (np.sort(np.concatenate([h for h, _ in langid.grams([t])])) == want).all()


def test_training_sample_is_bounded_and_never_empty(spark, docs):
    texts = [f"text number {k}" for k in range(900)] + ["the same"] * 600
    df = docs(texts, ["aa"] * 800 + ["bb"] * 100 + ["aa"] * 600).select("lang", "text")
    by = {r["lang"]: r["count"] for r in langid.sample(df, 90).groupBy("lang").count().collect()}
    assert 20 <= by["aa"] <= 90 and 60 <= by["bb"] <= 100
    # A table of 1e11 rows: the line is a double below 2 ** 63, never cut to 0.
    assert 5_000 * float(1 << 63) / 1e11 > 1e11


def test_decontamination_of_rows_without_id(spark):
    rng = random.Random(38)
    item = prose(rng, 20)
    rows = [(None, f"{prose(rng, 20)} {item}"), (None, prose(rng, 40)), (4, f"{item} {prose(rng, 9)}"), (4, prose(rng, 30)), (5, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontam.drop_contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, spark.createDataFrame([rows[k] for k in (1, 3, 4, 5)], df.schema).collect()))


def test_bundles_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(39)
    pages = spark.createDataFrame([(k, "u", prose(rng, 30)) for k in range(200)], "page_id long, url string, html string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a bundle for each partition
    index = warc.write_warc(pages, f"file://{tmp_path}/many")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = warc.read_warc(index)
    assert read.count() == 200 and read.rdd.getNumPartitions() == index.select("bundle").distinct().count() > 1


def test_substring_recall_and_repeats_within_a_document(spark, docs):
    rng = random.Random(40)
    texts = []
    for _ in range(150):
        passage = prose(rng, 80)[: substring.PASSAGE]
        texts += [f"{prose(rng, rng.randint(20, 40))}|{passage}|{prose(rng, 30)}" for _ in range(2)]
    twice = prose(rng, 50)
    texts += [f"{prose(rng, 20)} {twice} {prose(rng, 20)} {twice}", *(prose(rng, 100) for _ in range(100))]
    spans = substring.repeated_spans(docs(texts)).collect()
    assert len({r["doc_id"] for r in spans if r["doc_id"] < 300}) >= 0.9 * 300
    own = [r for r in spans if r["doc_id"] == 300]
    assert len(own) == 2 and all(r["other"] == 300 for r in own) and not [r for r in spans if r["doc_id"] > 300]
    for r in spans:  # against brute force: every span stands in its other document, or twice in its own
        part, other = texts[r["doc_id"]].encode()[r["start"] : r["end"]], texts[r["other"]].encode()
        assert other.count(part) > (r["doc_id"] == r["other"])


def test_scattered_chunks_are_no_span(spark, docs):
    rng = random.Random(41)
    long = prose(rng, 400)
    ends = [0, *substring.boundaries(np.frombuffer(long.encode(), np.uint8), np.array([0])).tolist()]
    parts = [long[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    mixed = [prose(rng, 8) + p + prose(rng, 8) for p in parts[:60]]  # each chunk in another document
    assert substring.repeated_spans(docs([long, *mixed])).count() == 0
