"""Patterns: reading, errors, and the automata against brute force."""

import itertools
import random
import re

import pytest

from lexigrid.functions import codes
from lexigrid.operators.datasets import LISTS, Datasets
from lexigrid.plans import packs
from lexigrid.plans.automata import Dfa, encode
from lexigrid.plans.build import Builder
from lexigrid.plans.catalog import CATALOG
from lexigrid.plans.explain import complete, conflict, derived_note, edit_note, plan, reasons, shown_score
from lexigrid.plans.lower import regex
from lexigrid.plans.syntax import And, Char, Not, PatternError, Rep, count_range, parse

BUILD = Datasets().builder()


def accepts(pattern: str, text: str) -> bool:
    return BUILD.dfa(parse(pattern)).accepts(text)


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("cat", ["cat", "c at", "c a t"], ["ca", "cats", "cot"]),
        ('"cat"', ["cat"], ["c at"]),
        ("A{2}#?", ["ab", "ab1", "a b"], ["a", "abc"]),
        ('"[a-c]+"', ["abc", "cab"], ["abd", ""]),
        ('"[^a-y ]"', ["z", "0"], ["a", " "]),
        ('"t-he"', ["the", "t he"], ["t  he"]),
        ("of|the", ["of", "the"], ["ofthe"]),
        ("A{3}&C*", ["bcd"], ["bad"]),
        ("!.*ee.*", ["ever"], ["feed", "fe ed"]),
        ("<abc>", ["cab", "a bc"], ["ab", "abcc"]),
        ("<<abc>>", ["abcabc", "c ab"], ["ab"]),
        ('{sum=6:"A*"}', ["abc", "f"], ["ab"]),
        ('{scrabble=10:"A"}', ["q", "z"], ["k"]),
        ('{count(vowel)=2:"A*"}', ["area"[:3] + "b"], ["bcd"]),
        ('{all(ab):"A*"}', ["cab"], ["ca"]),
        ('{maxrep=1:"A{3}"}', ["abc"], ["aab"]),
        ("{sub:aab}", ["a", "ab", "ba a"], ["bb", "c"]),
        ("{del1:abc}", ["ab", "bc", "ac"], ["abc", "a"]),
        ("{add1:ab}", ["abc", "xab", "aab"], ["ab", "a b"]),
        ("{subst1:ab}", ["ac", "xb"], ["ab", "abc"]),
        ("{edit=2:ab}", ["ab", "abcd", "xy"], ["abcde"]),
        ("{edit=1:ab}", ["a", "abc"], ["ab"]),
        ("{del1(a):aba}", ["ba", "ab"], ["aa"]),
        ("{caesar:ab}", ["bc", "za"], ["ab"]),
        ("{rot13:no}", ["ab"], ["no"]),
        ("{atbash:zy}", ["ab"], ["zy"]),
        ("{vigenere(b):bc}", ["ab"], ["bc"]),
        ("{t9:23}", ["ad", "cf"], ["ag"]),
        ("{enum:1,2}", ["a bc"], ["ab c"]),
        ("{morse:....}", ["h", "ii", "eeee", "se"], ["s"]),
        ("{a1z26:12}", ["ab", "l"], ["a"]),
        ("{braille:21 / 1}", ["b a"], ["ab"]),
        ("{bin5:00001}", ["a"], ["b"]),
        ("{semaphore:sw-s}", ["a"], ["b"]),
        ("{ascii:97 01100010 0x63}", ["abc"], ["ab"]),
        ("{polybius:11 24}", ["ai", "aj"], ["ak"]),
        ("{elements:A*}", ["cons", "he"], ["j"]),
        ("{holes=2:A*}", ["bb"], ["ba"]),
        ("{ascending:A*}", ["abbc"], ["ba"]),
        ("{descending:A*}", ["cba"], ["ab"]),
        ("{list:planets}", ["mars"], ["moon"]),
        ("x{list:a,b}y", ["xay", "xby"], ["xcy"]),
    ],
)
def test_accepts(pattern, yes, no):
    assert [t for t in yes if not accepts(pattern, t)] == []
    assert [t for t in no if accepts(pattern, t)] == []


def test_precedence():
    assert isinstance(parse("a&b"), And)
    assert parse("!a&b").parts[0] == Not(Char(frozenset("a"), True))
    assert parse("a{2,}") == Rep(Char(frozenset("a"), True), 2, None)


@pytest.mark.parametrize(
    ("pattern", "says"),
    [
        ("{sumn=3:A}", 'did you mean "sum"'),
        ("{word.sum=3:A}", "group count"),
        ("{sum}", "needs an argument"),
        ("{sum=9999:A}", "under 5000"),
        ("<ab", "expected"),
        ("<a>", "needs two"),
        ("[z-a]", "no range"),
        ("a{300}", "up to 255"),
        ("{compound 9:A}", "2 to 5"),
        ("{palindrome:{palindrome:A}}", "applied twice"),
        ("{rev a,b:{=a:A}A}", "nothing inside is captured"),
        ("{del1:{palindrome:A}}", "can't stand inside"),
        ("{~sum=3:A}", "weighted form"),
        ("{iso:a1}", "letters and spaces"),
        ("{list:planet}", 'did you mean "planets"'),
    ],
)
def test_errors(pattern, says):
    with pytest.raises(PatternError, match=says.replace("(", r"\(")):
        BUILD.nfa(parse(pattern))


def test_ranges():
    assert [count_range(s) for s in ("=3", "<3", "<=3", ">3", ">=3", "1..4", "=1..4", "x", "4..1")] == [(3, 3), (0, 2), (0, 3), (4, None), (3, None), (1, 4), (1, 4), None, None]


def test_every_example_parses():
    for c in CATALOG.values():
        parse(c.example)
    assert len(CATALOG) == 57 and "greek" in LISTS


def random_pattern(rng: random.Random, depth: int = 3) -> str:
    kind = rng.randrange(8 if depth else 3)
    if kind < 3:
        return rng.choice(["a", "b", "[ab]", "A", "[^a ]"])
    if kind == 3:
        return f"({random_pattern(rng, depth - 1)}|{random_pattern(rng, depth - 1)})"
    if kind == 4:
        return f"({random_pattern(rng, depth - 1)}){rng.choice(['*', '?', '+', '{1,2}'])}"
    if kind == 5 and depth == 3:
        return f"({random_pattern(rng, 2)}&!{random_pattern(rng, 1)})"
    return random_pattern(rng, depth - 1) + random_pattern(rng, depth - 1)


def test_regex_equals_automaton():
    rng, texts = random.Random(5), ["".join(t) for n in range(5) for t in itertools.product("ab ", repeat=n)]
    compared = 0
    for _ in range(120):
        source = random_pattern(rng)
        for pattern in (source, f'"{source}"'):
            node = parse(pattern)
            found = regex(node, BUILD)
            dfa = BUILD.dfa(node)
            if found is None:
                continue
            compared += 1
            assert [dfa.accepts(t) for t in texts] == [re.fullmatch(found, t) is not None for t in texts], pattern
    assert compared > 100


def test_dfa_algebra():
    rng, texts = random.Random(9), ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)]
    for _ in range(60):
        a, b = (BUILD.dfa(parse(f'"{random_pattern(rng, 2)}"')) for _ in "xy")
        assert [a.product(b).accepts(t) for t in texts] == [a.accepts(t) and b.accepts(t) for t in texts]
        assert [a.complement().accepts(t) for t in texts] == [not a.accepts(t) for t in texts]
        assert a.complement().complement().equivalent(a)
        assert [Dfa.of(a.nfa().reversed()).accepts(t[::-1]) for t in texts] == [a.accepts(t) for t in texts]
        state = a.run(encode(texts))
        assert [s >= 0 and bool(a.accept[s]) for s in state] == [a.accepts(t) for t in texts]


def test_playfair_decodes_the_public_example():
    cells = codes.readings("playfair", "(playfairexample)", "bmodzbxdnabekudmuixmmouvif")[0]
    assert "".join(c[0][0] for c in cells).replace("j", "i") == "hidethegoldinthetrexestump"


def test_plan_and_reasons(spark):
    assert plan("A{5}&A{6}")["empty"] and "exclude" in conflict(parse("A{5}&A{6}"), Builder())
    assert plan("{rhyme:day}")["missing"] == ["phonetic"]
    assert plan("{sum=52:A*}&A{4}")["letters"] == (4, 4)
    assert all(ok for ok, _ in reasons('{sum=33:"A*"}', "the")) and "33" in reasons('{sum=33:"A*"}', "the")[0][1]
    assert edit_note("beast", "best") == "beast −a" and edit_note("cargo", "largo") == "cargo c→l"
    assert derived_note("{caesar:wkh}", "the") == "shift +23"
    assert complete("{pal") == ["palindrome"] and "planets" in complete("{list:pl") and complete("{~ne") == ["near"]
    assert shown_score(1234567890.0) == "1.2345679e+09"


def test_packs():
    rows = [
        {"name": "soft", "type": "letter-class", "letters": "ae"},
        {"name": "worth", "type": "value-table", "values": {"a": 2}},
        {"name": "swapped", "type": "substitution", "map": {"a": "x"}},
    ]
    loaded = packs.load({"name": "p", "constructs": rows})
    b = Builder(packs=loaded)
    assert b.dfa(parse('{soft:"A*"}', loaded)).accepts("aea") and not b.dfa(parse('{soft:"A*"}', loaded)).accepts("ab")
    assert b.dfa(parse('{worth=4:"A*"}', loaded)).accepts("aba")
    assert b.dfa(parse("{swapped:bab}", loaded)).accepts("bxb")
    with pytest.raises(PatternError, match="own constructs"):
        packs.load({"name": "p", "constructs": [{"name": "sum", "type": "letter-class", "letters": "a"}]})
