"""Phrase tables and searches on small corpora, against counts and acceptors in plain Python."""

import random
import re
from collections import Counter

import pytest

from lexigrid.operators import datasets as D
from lexigrid.operators import predicates as P
from lexigrid.operators.search import Engine, folded, folded_page, merged
from lexigrid.operators.verify import Knowledge, Verifier, best_split, isomorph
from lexigrid.plans.syntax import PatternError, parse
from lexigrid.sources import corpus as C
from lexigrid.sources import pages as G
from lexigrid.sources.manifest import Manifest
from lexigrid.streaming import counts as S

GOLDEN = ["the quick brown fox", "the lazy dog", "the quick dog"]


def grams(lines, most=3):
    out = Counter()
    for line in lines:
        text = re.sub("[^A-Za-z0-9]+", " ", line.replace("'", "")).lower()
        for segment in re.sub("([a-z0-9]{40})+", "\n", text).split("\n"):
            w = segment.split()
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    g = " ".join(w[i : i + n])
                    if len(g) <= 39:
                        out[g] += 1
    return out


def table(spark, lines):
    return C.phrase_table(spark.createDataFrame([("\n".join(lines),)], "text string"))


@pytest.fixture(scope="module")
def engine(spark):
    lines = [*GOLDEN, "level door", "trap part", "abba noon", "irk vex", "a man a plan", "thunderbird bird thunder", "thunder bird", "heart earth"]
    t = table(spark, lines).persist()
    return Engine(t, D.Datasets(stress=spark.createDataFrame([("the", "0"), ("lazy", "10"), ("dog", "1")], "word string, shape string")))


def texts(df):
    return {r["text"] for r in df.collect()}


def test_counts(spark):
    odd = ["Don't stop, Émile!", "x" * 45 + " tail", "a  b\tc", "", "y" * 40, "one " + "z" * 85 + " two"]
    for lines in (GOLDEN, odd):
        got = {r["text"]: r["score"] for r in table(spark, lines).collect()}
        assert got == grams(lines)
    t = table(spark, GOLDEN)
    assert C.total(t).first()[0] == 10
    assert C.dump(t).first()[0] == "    1 [brown ]"
    assert [r["text"] for r in C.head(t, 2).collect()] == ["the", "dog"]


def test_weights_merge_and_wordlists(spark):
    docs = spark.createDataFrame([("my title\nbody text",), (None,)], "text string")
    assert {r["text"]: r["score"] for r in C.counted(C.titled_lines(docs), 1).collect()} == {"my": 10, "title": 10, "body": 1, "text": 1}
    t = C.counted(C.lines(docs), 1)
    assert {r["text"]: r["score"] for r in C.merge([t, t], 2).collect()} == dict.fromkeys(["my", "title", "body", "text"], 2)
    uni = spark.createDataFrame([("new", 5), ("old", 1)], "text string, score long")
    bi = spark.createDataFrame([("new york", 4), ("new day", 3), ("old", 9)], "text string, score long")
    assert {r["text"]: r["score"] for r in C.from_wordlists(uni, bi).collect()} == {"new": 7, "old": 1, "new york": 4, "new day": 3}


def test_save_and_load(spark, tmp_path):
    C.save(table(spark, GOLDEN), str(tmp_path / "t"))
    assert C.load(spark, str(tmp_path / "t")).count() == len(grams(GOLDEN))
    Manifest("tiny", "de", True).save(spark, str(tmp_path / "t"))
    m = Manifest.load(spark, str(tmp_path / "t"))
    assert m.description == "tiny" and m.query("straße über café") == "strasse ueber cafe"
    with pytest.raises(PatternError):
        Manifest.from_json("{")


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        ('"A{3}"&!.*o.*', {"the", "man", "irk", "vex"}),
        ("{palindrome:A{4,}}", {"level", "abba", "noon"}),
        ("{compound 2:A{11}}", {"thunderbird"}),
        ("{reversible:A{4}}", {"trap", "part"}),
        ("{iso:xyyx}", {"abba", "noon"}),
        ("{syllables=2:A*}", {"lazy"}),
        ("{stress 010:A*}", {"the lazy"}),
        ("{anagram earth:A*}", {"heart"}),
        ("{palindrome:A{5}} A{4}", {"level door"}),
        ('{rev a,b:"{=a:A{4}} {=b:A{4}}"}', {"trap part", "abba abba"} & {"trap part"}),
        ('{shift13 a,b:"{=a:A{3}} {=b:A{3}}"}', {"irk vex"}),
        ("{palindrome:A{4}}|door", {"abba", "noon", "door"}),
        ("A{5}&{palindrome:A*}", {"level"}),
        ("!{palindrome:A*}&\"A{5}\"", {"quick", "brown", "heart", "earth"}),
    ],
)
def test_predicates(engine, pattern, found):
    got = texts(engine.search(pattern, k=None))
    assert {g for g in got if g in found or " " not in g or "level" in g or "trap" in g or "irk" in g or "lazy" in g} >= found
    assert found <= got
    node = parse(pattern)
    know = engine.knowledge(node)
    check = Verifier(node, engine.builder, know)
    everything = {r["text"] for r in engine.table.select("text").collect()}
    assert got == {t for t in everything if check.check(t) is not None}


SIDES = {"p": ("A{3}", lambda t: t == t[::-1]), "n": ("A{2}", lambda t: True), "r": ("A{4}", lambda t: t[::-1] in ("part", "stop") and t != t[::-1])}


@pytest.mark.parametrize("seed", range(40))
def test_spans_against_brute_force(seed):
    """Random chains of pieces, some of them predicates, against every way to cut the text."""
    rng = random.Random(seed)
    kinds = rng.choices("pnr", k=rng.randint(2, 3))
    named = {"p": "{palindrome:A{3}}", "n": "A{2}", "r": "{reversible:A{4}}"}
    glue = rng.choice(["", " "])
    check = Verifier(parse('"' + glue.join(named[k] for k in kinds) + '"'), D.Datasets().builder(), Knowledge({"part": 5, "stop": 5}, 10))
    pieces = {"p": ["abc", "pop", "ana", "xyx", "tra"], "n": ["ab", "zz", "st"], "r": ["trap", "pots", "abba", "door"]}
    for _ in range(12):
        parts = [rng.choice(pieces[k]) for k in kinds]
        want = all(SIDES[k][1](p) for k, p in zip(kinds, parts, strict=True))
        assert (check.check(glue.join(parts)) is not None) == want, (kinds, parts)


@pytest.mark.parametrize(("relation", "holds"), [("eq", lambda a, b: a == b), ("rev", lambda a, b: a == b[::-1]), ("shift1", lambda a, b: [ord(y) - ord(x) for x, y in zip(a, b, strict=True)] == [1] * len(a))])
def test_relations_against_brute_force(relation, holds):
    check = Verifier(parse(f'{{{relation} p,q:"{{=p:A{{2}}}}-{{=q:A{{2}}}}"}}'), D.Datasets().builder(), Knowledge({}, 10))
    every = [x + y for x in "abc" for y in "abc"]
    for a in every:
        for b in every:
            assert (check.check(f"{a} {b}") is not None) == holds(a, b), (a, b)


def test_splits_and_isomorphs():
    known = {"ab", "abc", "cd", "d", "de", "cde"}.__contains__
    assert best_split("abcde", 2, known) == ["ab", "cde"]
    assert best_split("abcde", 3, known) is None
    assert isomorph("noon", "xyyx") == {"x": "n", "y": "o"} and isomorph("nonn", "xyyx") is None


def test_weights_and_edits(engine):
    rows = engine.search('{~list:dog,cat}&"A{3}"', k=2).collect()
    assert [(r["text"], r["score"]) for r in rows] == [("dog", 2.0), ("the", 0.03)]
    graded = engine.search("{edit:bird}", k=2).collect()
    assert graded[0]["text"] == "bird" and graded[0]["score"] == 2.0
    assert texts(engine.search("{edit<=1:{list:dog,man}}", k=None)) == {"dog", "man"}


def test_segments_match_a_simulation(spark):
    lines = ["a b", "b a", "ab a", "c"]
    e = Engine(table(spark, lines))
    counts, n = grams(lines), 7
    for pattern in ('"A+ A+ A+ A+"', '"a b a"', "ab"):
        dfa = e.product(parse(pattern))
        want = {}
        for s, cs in counts.items():
            if dfa.accepts(s):
                want[s] = max(want.get(s, 0), cs)
            for t, ct in counts.items():
                if dfa.accepts(f"{s} {t}"):
                    want[f"{s} {t}"] = max(want.get(f"{s} {t}", 0), cs * 1e-6 / n * ct)
        got = {r["text"]: r["score"] for r in e.search(pattern, k=None, segments=2).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)
    assert len(e.search('"a b a b a b"', k=None, segments=3).collect()) == 1


def test_pages_floor_merge_fold(spark, engine):
    every = [r["text"] for r in engine.search("A*", k=None).collect()]
    first = engine.search("A*", k=5).collect()
    more = engine.search("A*", k=5, after=(first[-1]["score"], first[-1]["text"])).collect()
    assert [r["text"] for r in first + more] == every[:10]
    assert texts(engine.search("A{3}", k=None, floor=1.0)) == {"the"}
    both = merged({"x": engine, "y": Engine(table(spark, ["the the the"]))}, '"the"').collect()
    assert both[0]["source"] == "y"
    df = spark.createDataFrame([("new york", 5.0), ("newyork", 4.0), ("old", 1.0)], "text string, score double")
    assert texts(folded(df)) == {"new york", "old"}
    rows = [{"text": t} for t in ("alpha centauri b", "the alpha centauri", "beta")]
    assert [r["text"] for r in folded_page(rows)] == ["alpha centauri b", "beta"]
    assert [r["score"] for r in engine.probe(["the", "none"]).orderBy("text").collect()] == [0, 3]


def test_reverse_table_gives_the_same(engine):
    back = Engine(engine.table, reverse=engine.table.sort("rev"))
    assert texts(back.search(".*bird", k=None)) == texts(engine.search(".*bird", k=None)) != set()


def test_pushdown(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    C.save(table(spark, GOLDEN), str(tmp_path / "t"))
    e = Engine(C.load(spark, str(tmp_path / "t")))
    plan = e.matches('"th.*"')._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(text,t)" in plan and "Python" not in plan
    assert "In(text" in e.matches("{list:the,dog}")._jdf.queryExecution().executedPlan().toString()


def test_debris_and_near(spark, engine):
    assert "thunder" in {r["word"] for r in P.pieces(engine.table, debris=True).collect()}
    near = spark.createDataFrame([("dog", 0), ("lazy", 1)], "entry string, rank int")
    got = P.near_order(engine.matches('"A{3,4}"'), near).select("text").limit(2).collect()
    assert [r[0] for r in got] == ["dog", "lazy"]


def test_datasets(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    phonetic = D.read_phonetics(spark, put("p", "R day way\nH night knight\n"))
    sense, edge = D.read_categories(spark, put("c", "bird|fowl\t1,2\nhen\t\nduck|mallard\t3\nteal\t\n"))
    data = D.Datasets(
        phonetic, D.read_stress(spark, put("s", "day 1\n")), D.read_thesaurus(spark, put("t", "big\tlarge\nbig\tgrand\n")), sense, edge,
        spark.createDataFrame([("king", 1, "queen")], "word string, rank int, neighbour string"), D.read_lists(spark, put("l", "ships\tboats\tark,argo\n")),
    )
    assert data.entries("rhyme", "", "day") == ["day", "way"] and data.entries("homo", "", "night") == ["knight", "night"]
    assert data.entries("like", "", "big") == ["big", "grand", "large"]
    assert data.entries("kind", "", "fowl") == ["bird", "duck", "fowl", "hen", "mallard", "teal"]
    assert data.entries("near", "", "king") == ["king", "queen"] and data.list("ships") == ["ark", "argo"]
    assert data.list("A, b-c") == ["a", "b c"]
    with pytest.raises(PatternError, match='did you mean "ships"'):
        data.list("ship")
    remote = D.remote_list(spark, put("r", "One!\n# no\ntwo # yes\n"), "https://x.example/l")
    assert D.Datasets(lists=remote).list("https://x.example/l") == ["one", "two"]
    words = spark.createDataFrame([("day", ["D", "EY1"]), ("way", ["W", "EY1"]), ("weigh", ["W", "EY1"])], "word string, phones array<string>")
    built = D.build_phonetics(words)
    assert sorted((r["kind"], r["word"]) for r in built.collect()) == [("H", "way"), ("H", "weigh"), ("R", "day"), ("R", "way"), ("R", "weigh")]
    assert {r["word"]: r["shape"] for r in D.build_stress(words).collect()} == {"day": "1", "way": "1", "weigh": "1"}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "word string, vector array<double>")
    ant = spark.createDataFrame([("a", "b")], "word string, antonym string")
    assert D.build_neighbours(v, v.where("word = 'a'"), 1).first()["neighbour"] == "b"
    assert D.build_neighbours(v, v.where("word = 'a'"), 1, ant).first()["neighbour"] == "c"


def test_pages(spark):
    html = "<html><head><title>x</title></head><body><p>One &amp; two</p><script>var a='<p>';</script><ul><li><a href='/a'>Alpha Beta</a></li><li><a href='/b'>a b c d</a></li></ul></body></html>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert df.select(G.html_text(df["html"])).first()[0].strip().split("\n")[0] == "One & two"
    assert [r["entry"] for r in G.harvested(df).collect()] == ["alpha beta"]
    wiki = spark.createDataFrame([("== Head ==\n'''Bold''' [[a|b]] [[c]] {{x}} <ref>n</ref>[http://e.org site]",)], "m string")
    assert wiki.select(G.wiki_text(wiki["m"])).first()[0] == "Head\nBold b c  site"


def test_harvest_ends_and_dump(spark, tmp_path):
    html = "<ul><li><a href='/a'>Alpha</a></li></ul><h2><span>See also</span></h2><ul><li><a href='/b'>Beta</a></li></ul>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r["entry"] for r in G.harvested(df).collect()] == ["alpha"]
    page = "<page><title>{}</title><ns>{}</ns>{}<revision><text{}>{}</text></revision></page>"
    pages = [("One", 0, "", ' bytes="9" xml:space="preserve"', "'''Bold''' &amp; [[x]]"), ("Two", 0, "", "", "plain"), ("Old", 0, '<redirect title="One" />', "", "#R"), ("Talk:One", 1, "", "", "chat")]
    (tmp_path / "dump.xml").write_text("<mediawiki>\n" + "\n".join(page.format(*p) for p in pages) + "\n</mediawiki>\n")
    assert {(r["title"], r["text"]) for r in G.read_dump(spark, str(tmp_path / "dump.xml")).collect()} == {("One", "'''Bold''' & [[x]]"), ("Two", "plain")}


def test_senses(spark, tmp_path):
    (tmp_path / "data.noun").write_text(
        "  1 a licence, indented\n00000010 05 n 02 domestic_dog 0 Dog's 1 003 @ 00000001 n 0000 ~ 00000020 n 0000 ~ 00000099 n 0000 | an animal\n00000020 05 n 01 puppy 0 000 | young | one\n"
    )
    (tmp_path / "data.adj").write_text("00000030 00 s 02 able(p) 0 capable 0 000 | fit\n")
    senses = D.read_senses(spark, str(tmp_path))
    groups: dict = {}
    for r in D.build_thesaurus(senses).collect():
        groups.setdefault(r["group_id"], set()).add(r["word"])
    assert sorted(map(sorted, groups.values())) == [["able", "capable"], ["dogs", "domestic dog"]]
    sense, edge = D.build_kinds(senses)
    assert {r[0] for r in D.kind_names(sense, edge, "dogs").collect()} == {"dogs", "domestic dog", "puppy"} and edge.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    for k, line in enumerate(GOLDEN):
        spark.createDataFrame([(line,)], "text string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("text string").parquet(str(src))
        S.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        got = {r["text"]: r["score"] for r in S.current(spark, str(tmp_path / "out")).collect()}
        assert got == grams(GOLDEN[: k + 1])
    S.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert S.current(spark, str(tmp_path / "small")).count() == len(grams(GOLDEN))


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_of_a_file_or_a_folder(spark, tmp_path, parts):
    from lexigrid.queries import QUERIES

    said = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(GOLDEN)], "conv_id long, turn long, role string, text string")
    said.repartition(parts or 1, "conv_id").write.parquet(str(tmp_path / "conversations.parquet" if parts else tmp_path / "written"))
    if not parts:
        next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    spark.createDataFrame([("not read",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["text"]: r["score"] for r in QUERIES["incremental_counts"](spark, str(tmp_path)).collect()} == grams(GOLDEN)


def test_stored_files_hold_no_derived_columns(spark, tmp_path):
    made, path = table(spark, GOLDEN), str(tmp_path / "t")
    C.store(made, path, 5)
    assert [spark.read.parquet(f"{path}/{k}").columns for k in ("text", "rev", "head")] == [["text", "score"], ["text", "score", "rev"], ["text", "score"]]
    e = Engine.open(spark, path)
    for t in (e.table, e.reverse):
        assert t.schema.names == made.schema.names and sorted(t.collect()) == sorted(made.collect())


def test_counts_by_longest_ngrams(spark):
    lines = ["a b a b a b", "a", "a b", "x" * 39 + " y z", "p " + "q" * 36 + " r s", "k " * 30, "u" * 41 + " v"]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    for most in (1, 2, 3, 5):
        rows = C.counted(C.lines(df), most).collect()
        assert len(rows) == len({r["text"] for r in rows}) and {r["text"]: r["score"] for r in rows} == grams(lines, most)


@pytest.mark.parametrize("pattern, want", [("{syllables>=2:A*}", ["quick dog", "the quick", "the quick dog"]), ("{stress 01:A*}", ["the quick"])])
def test_stress_deals_out_only_what_may_match(spark, monkeypatch, pattern, want):
    met, shapes = [], P.shapes
    monkeypatch.setattr(P, "shapes", lambda df, stress: met.append(df) or shapes(df, stress))
    data = D.Datasets(stress=spark.createDataFrame([("the", "0"), ("dog", "1"), ("quick", "1")], "word string, shape string"))
    found = Engine(table(spark, GOLDEN), data).search(pattern, k=None).select("text").collect()
    assert sorted(r["text"] for r in found) == want
    assert {r["text"] for r in met[0].select("text").collect()} == {"the", "dog", "quick", "the quick", "the quick dog", "quick dog", "the lazy dog"}
