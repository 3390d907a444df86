"""Tables and readings of the literal constructs: letter values, shapes, ciphers and spelling codes."""

from __future__ import annotations

import re
from itertools import product

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: A reading: for each place the characters it may hold, and whether it may be left out.
Cells = list[tuple[str, bool]]
MOST_LITERAL = 255

# Fixed values.
SCRABBLE = {"a": 1, "b": 3, "c": 3, "d": 2, "e": 1, "f": 4, "g": 2, "h": 4, "i": 1, "j": 8, "k": 5, "l": 1, "m": 3, "n": 1, "o": 1, "p": 3, "q": 10, "r": 1, "s": 1, "t": 1, "u": 1, "v": 4, "w": 4, "x": 8, "y": 4, "z": 10}
SHAPES = {
    "roman": "cdilmvx",
    "rot180": "hinosxz",
    "mirror": "ahimotuvwxy",
    "sevenseg": "abcdefghijlnopqrstuy",
    "row1": "qwertyuiop",
    "row2": "asdfghjkl",
    "row3": "zxcvbnm",
}
HOLES = {0: "cefghijklmnstuvwxyz1234567", 1: "adopqr0469", 2: "b8"}
KEYPAD = {"2": "abc", "3": "def", "4": "ghi", "5": "jkl", "6": "mno", "7": "pqrs", "8": "tuv", "9": "wxyz"}
MORSE = {
    "a": ".-", "b": "-...", "c": "-.-.", "d": "-..", "e": ".", "f": "..-.", "g": "--.", "h": "....", "i": "..",
    "j": ".---", "k": "-.-", "l": ".-..", "m": "--", "n": "-.", "o": "---", "p": ".--.", "q": "--.-", "r": ".-.",
    "s": "...", "t": "-", "u": "..-", "v": "...-", "w": ".--", "x": "-..-", "y": "-.--", "z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...",
    "8": "---..", "9": "----.",
}
BRAILLE = {
    "a": "1", "b": "12", "c": "14", "d": "145", "e": "15", "f": "124", "g": "1245", "h": "125", "i": "24", "j": "245",
    "k": "13", "l": "123", "m": "134", "n": "1345", "o": "135", "p": "1234", "q": "12345", "r": "1235", "s": "234",
    "t": "2345", "u": "136", "v": "1236", "w": "2456", "x": "1346", "y": "13456", "z": "1356",
}
SEMAPHORE = {
    "a": "s sw", "b": "s w", "c": "nw s", "d": "n s", "e": "ne s", "f": "e s", "g": "s se", "h": "sw w", "i": "nw sw",
    "j": "e n", "k": "n sw", "l": "ne sw", "m": "e sw", "n": "se sw", "o": "nw w", "p": "n w", "q": "ne w", "r": "e w",
    "s": "se w", "t": "n nw", "u": "ne nw", "v": "n se", "w": "e ne", "x": "ne se", "y": "e nw", "z": "e se",
}
ELEMENTS = (
    "h he li be b c n o f ne na mg al si p s cl ar k ca sc ti v cr mn fe co ni cu zn ga ge as se br kr rb sr y zr nb mo"
    " tc ru rh pd ag cd in sn sb te i xe cs ba la ce pr nd pm sm eu gd tb dy ho er tm yb lu hf ta w re os ir pt au hg tl"
    " pb bi po at rn fr ra ac th pa u np pu am cm bk cf es fm md no lr rf db sg bh hs mt ds rg cn nh fl mc lv ts og"
).split()
SQUARE = "abcdefghiklmnopqrstuvwxyz"


def value(name: str, char: str) -> int:
    """A character's value under sum or scrabble; spaces and digits have none."""
    if char not in LETTERS:
        return 0
    return ord(char) - 96 if name == "sum" else SCRABBLE[char]


def named_set(spec: str) -> str | None:
    """The characters of (vowel), (consonant), (letter), (digit) or written out."""
    inner = spec.strip().removeprefix("(").removesuffix(")").strip().lower()
    known = {"vowel": "aeiou", "letter": LETTERS, "digit": DIGITS, "consonant": "".join(c for c in LETTERS if c not in "aeiou")}
    found = known.get(inner.removesuffix("s")) or inner.replace(" ", "")
    return found if found and all(c in LETTERS + DIGITS for c in found) else None


def set_and_range(spec: str) -> tuple[str, str] | None:
    """(set) and what follows it."""
    m = re.fullmatch(r"\(([^)]*)\)\s*(.*)", spec.strip())
    return (m[1], m[2]) if m else None


def shifted(text: str, n: int) -> str:
    return "".join(LETTERS[(LETTERS.index(c) + n) % 26] if c in LETTERS else c for c in text)


def _plain(text: str) -> Cells:
    return [(c, False) for c in text]


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\s,]+", text.lower().replace("/", " / ")) if t]


def _by_token(text: str, read) -> list[Cells]:
    """One reading, token by token; / is a space; None from read refuses the text."""
    cells: Cells = []
    for token in _tokens(text):
        got = " " if token == "/" else read(token)
        if not got:
            return []
        cells.append((got, False))
    return [cells] if cells else []


def _shifts(text: str, spec: str) -> list[Cells]:
    if not re.fullmatch(r"[a-z ]+", text) or len(text) > MOST_LITERAL:
        return []
    n = int(spec.lstrip("+")) % 26 if re.fullmatch(r"\+?\d+", spec) else None
    if spec and n is None:
        return []
    return [_plain(shifted(text, k)) for k in ([n] if n is not None else range(1, 26))]


def _vigenere(text: str, key: str) -> list[Cells]:
    if not re.fullmatch(r"[a-z]+", key) or not re.fullmatch(r"[a-z ]+", text):
        return []
    out, k = "", 0
    for c in text:
        out += c if c == " " else shifted(c, -LETTERS.index(key[k % len(key)]))
        k += c != " "
    return [_plain(out)]


def _playfair(text: str, key: str) -> list[Cells]:
    """Pairs in a row step left, in a column up, else swap columns. A decoded i may be j; an x may be padding."""
    text = re.sub(r"[\s,]+", "", text).replace("j", "i")
    if not re.fullmatch(r"[a-z]+", key) or not re.fullmatch(r"(?:[a-z]{2})+", text):
        return []
    square = "".join(dict.fromkeys(key.replace("j", "i") + SQUARE))
    out = ""
    for a, b in zip(text[::2], text[1::2], strict=True):
        (r, c), (s, d) = divmod(square.index(a), 5), divmod(square.index(b), 5)
        if a == b:
            return []
        if r == s:
            places = (r, (c - 1) % 5), (s, (d - 1) % 5)
        elif c == d:
            places = ((r - 1) % 5, c), ((s - 1) % 5, d)
        else:
            places = (r, d), (s, c)
        out += "".join(square[5 * x + y] for x, y in places)
    cells = [("ij" if c == "i" else c, c == "x") for c in out]
    return [] if all(skip for _, skip in cells) else [cells]


def _fives(text: str, marks: str) -> list[int]:
    bits = re.sub(r"[\s,]+", "", text)
    if not bits or len(bits) % 5 or set(bits) - set(marks):
        return []
    return [int("".join(str(marks.index(c)) for c in bits[k : k + 5]), 2) for k in range(0, len(bits), 5)]


def _bacon(text: str) -> list[Cells]:
    values, old = _fives(text, "ab"), ["ij" if c == "i" else "uv" if c == "u" else c for c in LETTERS if c not in "jv"]
    return [[(table[v], False) for v in values] for table in (LETTERS, old) if values and max(values) < len(table)]


def _ascii(token: str) -> str | None:
    base = 2 if re.fullmatch(r"[01]{8}", token) else 16 if re.fullmatch(r"0x[0-9a-f]+", token) else 10 if token.isdigit() else None
    code = int(token, base) if base else -1
    c = chr(code).lower() if 0 <= code < 128 else ""
    return c if c and c in LETTERS + DIGITS + " " else None


def _polybius(text: str) -> list[Cells]:
    pairs = re.sub(r"[\s,]+", "", text)
    if not re.fullmatch(r"(?:[1-5]{2})+", pairs):
        return []
    found = (SQUARE[5 * int(a) + int(b) - 6] for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return [[({"i": "ij", "c": "ck"}.get(c, c), False) for c in found]]


def _enum(text: str) -> list[Cells]:
    sizes = [p.strip() for p in text.split(",")]
    if not all(s.isdigit() and 1 <= int(s) <= 40 for s in sizes) or sum(map(int, sizes)) > MOST_LITERAL:
        return []
    cells: Cells = []
    for k, s in enumerate(sizes):
        cells += [(" ", False)] * (k > 0) + [(LETTERS, False)] * int(s)
    return [cells]


def readings(name: str, spec: str, text: str) -> list[Cells]:
    """The readings of a literal construct other than morse and a1z26; empty if the text is no such code."""
    text = text.lower()
    key = spec.strip().removeprefix("(").removesuffix(")").strip().lower()
    match name:
        case "caesar":
            return _shifts(text, spec)
        case "rot":
            return _shifts(text, spec) if spec else []
        case "rot13":
            return _shifts(text, "13") if not spec else []
        case "atbash":
            return [_plain("".join(LETTERS[25 - LETTERS.index(c)] if c in LETTERS else c for c in text))] if re.fullmatch(r"[a-z ]+", text) and not spec else []
        case "vigenere":
            return _vigenere(text, key)
        case "playfair":
            return _playfair(text, key)
        case "t9":
            return [[(KEYPAD[d], False) for d in text]] if text and all(d in KEYPAD for d in text) else []
        case "enum":
            return _enum(text)
        case "braille":
            dots = {v: k for k, v in BRAILLE.items()}
            return _by_token(text, lambda t: dots.get("".join(sorted(set(t)))))
        case "bacon":
            return _bacon(text)
        case "bin5":
            values = _fives(text, "01")
            return [_plain("".join(LETTERS[v - 1] for v in values))] if values and all(1 <= v <= 26 for v in values) else []
        case "semaphore":
            flags = {v: k for k, v in SEMAPHORE.items()}
            return _by_token(text, lambda t: flags.get(" ".join(sorted(t.split("-")))))
        case "ascii":
            return _by_token(text, _ascii)
        case "polybius":
            return _polybius(text)
    return []


def splits(name: str, text: str) -> list[tuple[int, int, str]] | None:
    """morse and a1z26: steps (from, to, character) between places of the code; 0 is the first, the largest the last."""
    if name == "morse":
        code = re.sub(r"\s+", "", text)
        if not re.fullmatch(r"[.-]{1,255}", code):
            return None
        return [(k, k + len(m), c) for k in range(len(code)) for c, m in MORSE.items() if code.startswith(m, k)]
    steps, at = [], 0
    for token in _tokens(text):
        if token == "/":
            steps.append((at, at + 1, " "))
            at += 1
            continue
        if not token.isdigit():
            return None
        own, reach = [], {0}
        for k in range(len(token)):
            for n in (1, 2):
                v = int(token[k : k + n])
                if k + n <= len(token) and token[k] != "0" and 1 <= v <= 26:
                    own.append((at + k, at + k + n, LETTERS[v - 1]))
                    if k in reach:
                        reach.add(k + n)
        if len(token) not in reach:
            return None
        steps += own
        at += len(token)
    return steps if steps and at <= MOST_LITERAL else None


def strings(cells: Cells, cap: int) -> list[str] | None:
    """The texts of a reading, or None beyond cap."""
    size = 1
    for chars, skip in cells:
        size *= len(chars) + skip
        if size > cap:
            return None
    return sorted({"".join(x) for x in product(*([*chars, *([""] if skip else [])] for chars, skip in cells))})


def check_named(node) -> str | None:
    """What is wrong with a construct's spec or text, or None."""
    from lexigrid.plans.syntax import MOST_EDITS, count_range

    name, spec = node.name, node.spec
    if name in ("sum", "scrabble", "letters", "words"):
        return None if count_range(spec) else f'"{spec}" is no comparison with a number under 5000'
    if name == "count":
        got = set_and_range(spec)
        return None if got and named_set(got[0]) and count_range(got[1]) else "it takes a set and a comparison"
    if name == "all":
        return None if named_set(spec) else "it takes a set in parentheses"
    if name == "maxrep":
        got = count_range(spec if not spec.isdigit() else f"={spec}")
        return None if got and got[1] else "it takes a number"
    if name in ("sub", "bank"):
        return None if re.fullmatch(r"[a-zA-Z ]*[a-zA-Z][a-zA-Z ]*", node.text) and not spec else "it takes letters"
    if name in ("del", "add", "subst", "edit"):
        got = edit_spec(name, spec)
        return None if got and (got[1] <= MOST_EDITS) else f"it takes 1 to {MOST_EDITS} edits"
    if name in ("morse", "a1z26"):
        return None if splits(name, node.text) else "that is no such code"
    if name == "holes":
        return None if re.fullmatch(r"=?\s*[012]", spec) else "it takes 0, 1 or 2"
    if name in (*SHAPES, "ascending", "descending", "distinct", "elements"):
        return f'"{spec}" is not understood' if spec else None
    if name == "near":
        return None if not spec or spec.isdigit() else "it takes a number of neighbours"
    if name in ("rhyme", "homo", "like", "kind", "list"):
        return None if node.text and not spec else "it takes a word"
    return None if readings(name, spec, node.text) else "that is no such code"


def edit_spec(name: str, spec: str) -> tuple[int, int, str | None, bool] | None:
    """(least, most, letters or None, graded) of an edit's spec."""
    from lexigrid.plans.syntax import count_range

    letters = None
    if m := re.search(r"\(([^)]*)\)", spec):
        letters = named_set(m[0])
        if letters is None:
            return None
        spec = (spec[: m.start()] + spec[m.end() :]).strip()
    if not spec:
        return (0, 3, letters, True) if name == "edit" else None
    got = count_range(f"={spec}" if spec.isdigit() else spec)
    return (got[0], got[1], letters, False) if got and got[1] else None
