"""The constructs of the pattern language: name, group, level, kind of argument, summary, example."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Construct:
    name: str
    group: str
    level: str  # "pattern" (part of the search) or "predicate" (asked of a finished match)
    argument: str  # "literal" (data), "wrap" (a pattern it narrows), "inner" (a pattern it is about)
    summary: str
    example: str


def _rows(group: str, level: str, argument: str, *rows: tuple[str, str, str]) -> list[Construct]:
    return [Construct(name, group, level, argument, summary, example) for name, summary, example in rows]


CATALOG = {
    c.name: c
    for c in [
        *_rows(
            "word", "pattern", "literal",
            ("rhyme", "ends in the same sounds as the word", "{rhyme:stone}"),
            ("homo", "sounds the same as the word", "{homo:pair}"),
            ("like", "a synonym: shares a sense with the word", "{like:quick}"),
            ("near", "the word or one of its nearest by vector", "{near 5:river}"),
            ("kind", "the word's senses and everything filed under them", "{kind:tree}"),
            ("list", "an entry of a list: by name, written out, or registered under an address", "{list:metals}"),
        ),
        *_rows(
            "count", "pattern", "wrap",
            ("sum", "letter values (a is 1, z is 26) add up to this", "{sum=40..45:A{4}}"),
            ("scrabble", "tile values add up to this", "{scrabble>=18:A{6}}"),
            ("count", "how many characters are of a set", "{count(rst)=3:A{6}}"),
            ("letters", "how many letters there are", "{letters=9:_*}"),
            ("words", "how many words there are", "{words=2:A*}"),
            ("all", "every character of a set occurs", "{all(xyz):A*}"),
            ("distinct", "all characters differ", "{distinct:A{8}}"),
            ("maxrep", "the commonest character occurs this often at most", "{maxrep=1:A{7}}"),
        ),
        *_rows(
            "bag", "pattern", "literal",
            ("sub", "made of some of these letters, none more often than it is written", "{sub:gardening}"),
            ("bank", "made of all these letters, each as often as you like", "{bank:least}"),
        ),
        *_rows(
            "edit", "pattern", "inner",
            ("del", "the inner text less n characters", "{del2:{list:days}}"),
            ("add", "the inner text with n characters more", "{add1:crow}"),
            ("subst", "the inner text with n characters changed", "{subst1:stone}"),
            ("edit", "at most n edits away; without a number the nearer weigh more", "{edit<=1:silver}"),
        ),
        *_rows(
            "cipher", "pattern", "literal",
            ("caesar", "the text shifted by any distance, or by +n", "{caesar:dro}"),
            ("rot", "the text shifted by this distance", "{rot5:mjqqt}"),
            ("rot13", "the text shifted by half the alphabet", "{rot13:pnxr}"),
            ("atbash", "the text with a for z, b for y and so on", "{atbash:xzpv}"),
            ("vigenere", "decoded by a key that repeats", "{vigenere(lemon):nem}"),
            ("playfair", "decoded by the square of a key", "{playfair(garden):gdra}"),
        ),
        *_rows(
            "spell", "pattern", "literal",
            ("t9", "typed with these telephone keys", "{t9:2255}"),
            ("enum", "words as long as these numbers say", "{enum:2,7}"),
            ("morse", "read from dots and dashes without gaps", "{morse:.--.}"),
            ("a1z26", "read from letter numbers without gaps", "{a1z26:1205}"),
            ("braille", "read from the dots of each cell", "{braille:14 1 2345}"),
            ("bacon", "read from fives of a and b, in the old or the new table", "{bacon:aaaba aaaaa}"),
            ("bin5", "read from fives of bits", "{bin5:00011 00001}"),
            ("semaphore", "read from the places of two flags", "{semaphore:sw-s w-s}"),
            ("ascii", "read from character codes", "{ascii:99 97 116}"),
            ("polybius", "read from rows and columns of the square", "{polybius:13 11 44}"),
        ),
        *_rows("spell", "pattern", "wrap", ("elements", "can be written in symbols of the elements", "{elements:A{8}}")),
        *_rows(
            "shape", "pattern", "wrap",
            ("roman", "only letters that are Roman digits", "{roman:A{3,}}"),
            ("rot180", "only letters that stay letters upside down", "{rot180:A{5,}}"),
            ("mirror", "only letters whose capitals look alike in a mirror", "{mirror:A{4,}}"),
            ("sevenseg", "only letters that a calculator's display can show", "{sevenseg:A{7}}"),
            ("holes", "this many closed loops in the characters", "{holes=2:A{4}}"),
            ("row1", "typed on the row of q", "{row1:A{7,}}"),
            ("row2", "typed on the row of a", "{row2:A{6}}"),
            ("row3", "typed on the row of z", "{row3:A{2}}"),
            ("ascending", "no letter before its neighbour on the left in the alphabet", "{ascending:A{6}}"),
            ("descending", "no letter after its neighbour on the left in the alphabet", "{descending:A{5}}"),
        ),
        *_rows(
            "match", "predicate", "wrap",
            ("compound", "falls into n words that the table knows", "{compound 3:A{10}}"),
            ("palindrome", "the same from either end", "{palindrome:A{7}}"),
            ("reversible", "the table knows its letters from the end too", "{reversible:A{5}}"),
            ("syllables", "so many syllables by the dictionary", "{syllables=4:A*}"),
            ("stress", "the dictionary's accents, 1 where one is and 0 where none is", "{stress 100:A{6,}}"),
            ("anagram", "the letters of a list's entry, or of a pattern's match, in another order", "{anagram metals:A{4}}"),
            ("iso", "letters repeat as in the given text", "{iso:abccba}"),
            ("eq", "two captures agree", "{eq p,q:{=p:A{2}}A{=q:A{2}}}"),
            ("rev", "a capture is another one from its end", "{rev p,q:{=p:A{4}}{=q:A{4}}}"),
            ("shift", "a capture is another one moved along the alphabet", "{shift3 p,q:{=p:A{4}} {=q:A{4}}}"),
        ),
    ]
}

SOFT = ("near", "rhyme", "homo", "like", "kind", "list")
RELATIONS = ("eq", "rev", "shift")


def distance(a: str, b: str) -> int:
    """Edit distance of two short names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def suggest(name: str, known: list[str] | None = None, most: int = 2) -> str | None:
    """The known name within most edits, the nearest first."""
    near = sorted((distance(name, k), k) for k in (known or list(CATALOG)))
    return near[0][1] if near and near[0][0] <= most else None
