"""Pattern text to syntax tree.

Precedence from loose to tight: | & ! juxtaposition, one quantifier, atom. Outside quotes a character atom takes spaces
on both sides, which its flag ``pad`` says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from lexigrid.plans.catalog import CATALOG, RELATIONS, SOFT, suggest

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = " " + DIGITS + LETTERS
VOWELS = "aeiou"
CLASSES = {
    "A": frozenset(LETTERS),
    "C": frozenset(LETTERS) - frozenset(VOWELS),
    "V": frozenset(VOWELS),
    "#": frozenset(DIGITS),
    "_": frozenset(DIGITS + LETTERS),
    ".": frozenset(ALPHABET),
}
#: Bounds of a quantifier and of a literal argument; of edits; of a counter.
MOST_REPEATS, MOST_EDITS, MOST_COUNT = 255, 5, 5000


class PatternError(ValueError):
    """A pattern that can't be read, and why."""


class Node:
    def children(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Char(Node):
    """One character of a set; with optional, also none."""

    chars: frozenset[str]
    pad: bool
    optional: bool = False


@dataclass(frozen=True)
class Seq(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Alt(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Not(Node):
    inner: Node

    def children(self):
        return (self.inner,)


@dataclass(frozen=True)
class Rep(Node):
    inner: Node
    least: int
    most: int | None

    def children(self):
        return (self.inner,)


@dataclass(frozen=True)
class Anagram(Node):
    parts: tuple[Node, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Named(Node):
    """A construct of level pattern: inner is its pattern (None for literal arguments)."""

    name: str
    spec: str
    text: str
    inner: Node | None = None
    soft: bool = False

    def children(self):
        return (self.inner,) if self.inner is not None else ()


@dataclass(frozen=True)
class Pred(Node):
    """A construct of level predicate. For iso, text is the cipher and inner its hull."""

    name: str
    spec: str
    inner: Node
    text: str = ""

    def children(self):
        return (self.inner,)


@dataclass(frozen=True)
class Cap(Node):
    name: str
    inner: Node

    def children(self):
        return (self.inner,)


def walk(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children():
        yield from walk(child)


def has_predicate(node: Node) -> bool:
    return any(isinstance(x, Pred) for x in walk(node))


def count_range(spec: str) -> tuple[int, int | None] | None:
    """(least, most) of =n <n <=n >n >=n a..b =a..b, most None where open; None if it is none of these."""
    spec = spec.replace(" ", "")
    if m := re.fullmatch(r"=?(\d+)\.\.(\d+)", spec):
        low, high = int(m[1]), int(m[2])
    elif m := re.fullmatch(r"(<=|>=|<|>|=)(\d+)", spec):
        n = int(m[2])
        low, high = {"=": (n, n), "<": (0, n - 1), "<=": (0, n), ">": (n + 1, None), ">=": (n, None)}[m[1]]
    else:
        return None
    if (high is not None and high < low) or max(low, high or 0) >= MOST_COUNT:
        return None
    return low, high


def seq(parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else Seq(tuple(parts))


class Parser:
    def __init__(self, text: str, packs: dict | None = None):
        self.text, self.packs = text, packs or {}

    def parse(self) -> Node:
        node, at = self.alternation(0, False)
        if at != len(self.text):
            self._explain(at)
        return node

    def _explain(self, at: int) -> None:
        rest = self.text[at:]
        if m := re.match(r"\{~?([a-z]+[a-z0-9]*)[^:}]*\}", rest):
            name = m[1] if m[1] in CATALOG else m[1].rstrip(DIGITS)
            if name in CATALOG:
                c = CATALOG[name]
                raise PatternError(f"{m[0]}: {name} ({c.summary}) needs an argument after a colon, as in {c.example}")
        raise PatternError(f"can't read the pattern from {rest[:30]!r} on")

    def alternation(self, at: int, quoted: bool) -> tuple[Node, int]:
        node, at = self.intersection(at, quoted)
        parts = [node]
        while at < len(self.text) and self.text[at] == "|":
            node, at = self.intersection(at + 1, quoted)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else Alt(tuple(parts))), at

    def intersection(self, at: int, quoted: bool) -> tuple[Node, int]:
        node, at = self.factor(at, quoted)
        parts = [node]
        while at < len(self.text) and self.text[at] == "&":
            node, at = self.factor(at + 1, quoted)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else And(tuple(parts))), at

    def factor(self, at: int, quoted: bool) -> tuple[Node, int]:
        if self.text[at : at + 1] == "!":
            inner, end = self.factor(at + 1, quoted)
            if end == at + 1:
                raise PatternError("! needs something to negate")
            return Not(inner), end
        parts = []
        while (found := self.piece(at, quoted)) is not None:
            node, at = found
            parts.append(node)
        return (seq(parts) if parts else Seq(())), at

    def piece(self, at: int, quoted: bool) -> tuple[Node, int] | None:
        found = self.atom(at, quoted)
        if found is None:
            return None
        node, at = found
        m = re.compile(r"([*+?])|\{(\d*)(,(\d*))?\}").match(self.text, at)
        if not m:
            return node, at
        if m[1]:
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]]
        else:
            low = int(m[2] or 0)
            high = low if m[3] is None else int(m[4]) if m[4] else None
        if low > MOST_REPEATS or (high is not None and not low <= high <= MOST_REPEATS):
            raise PatternError(f"{m[0]}: the bounds of a quantifier rise, up to {MOST_REPEATS}")
        return Rep(node, low, high), m.end()

    def close(self, at: int, mark: str) -> int:
        if self.text[at : at + len(mark)] != mark:
            self._explain(at) if self.text[at : at + 1] == "{" else None
            raise PatternError(f"{mark} expected at {self.text[at:][:20]!r}")
        return at + len(mark)

    def atom(self, at: int, quoted: bool) -> tuple[Node, int] | None:
        c = self.text[at : at + 1]
        if c == '"' and not quoted:
            node, end = self.alternation(at + 1, True)
            return node, self.close(end, '"')
        if c == "(":
            node, end = self.alternation(at + 1, quoted)
            return node, self.close(end, ")")
        if c == "<":
            if self.text[at + 1 : at + 2] == "<":
                end = self.text.find(">>", at)
                if end < 0:
                    raise PatternError("<< without >>")
                return self.check(Named("bank", "", self.text[at + 2 : end])), end + 2
            parts, end = [], at + 1
            while (found := self.piece(end, quoted)) is not None:
                parts.append(found[0])
                end = found[1]
            end = self.close(end, ">")
            if len(parts) < 2:
                raise PatternError("<...> rearranges the parts between the brackets, and needs two; to rearrange what a pattern matches, write {anagram pattern:...}")
            return Anagram(tuple(parts)), end
        if c == "{":
            return self.braces(at, quoted)
        if c == "[":
            return self.charset(at, quoted)
        got = self.char(at)
        return got and (Char(got[0], not quoted, got[1]), at + 1)

    def char(self, at: int) -> tuple[frozenset[str], bool] | None:
        """The characters that one sign stands for, and whether also none."""
        c = self.text[at : at + 1]
        if c == "-":
            return frozenset(" "), True
        if c in CLASSES:
            return CLASSES[c], False
        return (frozenset(c), False) if c and c in ALPHABET else None

    def charset(self, at: int, quoted: bool) -> tuple[Node, int]:
        end = self.text.find("]", at)
        body = self.text[at + 1 : end]
        if end < 0:
            raise PatternError("[ without ]")
        negate = body.startswith("^")
        body, chars, optional, k = body.removeprefix("^"), set(), False, 0
        while k < len(body):
            if body[k] == "-" and 0 < k < len(body) - 1:
                low, high = body[k - 1], body[k + 1]
                span = [chr(x) for x in range(ord(low), ord(high) + 1)]
                if not span or any(x not in ALPHABET for x in span):
                    raise PatternError(f"[{low}-{high}] is no range of letters or digits")
                chars.update(span)
                k += 2
                continue
            got = Parser(body[k]).char(0)
            if got is None:
                raise PatternError(f"{body[k]!r} can't stand in [...]")
            chars |= got[0]
            optional |= got[1]
            k += 1
        if negate:
            return Char(frozenset(ALPHABET) - chars, not quoted), end + 1
        return Char(frozenset(chars), not quoted, optional), end + 1

    def end_of(self, at: int) -> tuple[int, int]:
        """(the colon, the closing brace) of the braces that open at at; the colon is the first outside inner braces."""
        depth, colon = 0, -1
        for k in range(at, len(self.text)):
            depth += {"{": 1, "}": -1}.get(self.text[k], 0)
            if self.text[k] == ":" and depth == 1 and colon < 0:
                colon = k
            if depth == 0:
                return colon, k
        raise PatternError("{ without }")

    def braces(self, at: int, quoted: bool) -> tuple[Node, int]:
        colon, end = self.end_of(at)
        if m := re.compile(r"\{=([a-z][a-z0-9]*):").match(self.text, at):
            node, stop = self.alternation(m.end(), quoted)
            return Cap(m[1], node), self.close(stop, "}")
        if colon < 0:
            self._explain(at)
        head = self.text[at + 1 : colon]
        soft, head = head.startswith("~"), head.removeprefix("~").strip()
        m = re.match(r"[a-z][a-z0-9.]*", head)
        if not m:
            raise PatternError(f"{{{head}:...}} names no construct")
        group, _, token = m[0].rpartition(".")
        name = token if token in CATALOG or token in self.packs else token.rstrip(DIGITS)
        spec = (token[len(name) :] + head[m.end() :]).strip()
        if name in self.packs and not group:
            return self.packed(name, spec, colon, end, quoted)
        if name not in CATALOG:
            near = suggest(name)
            raise PatternError(f'no construct is named "{name}"' + (f'; did you mean "{near}"?' if near else ""))
        c = CATALOG[name]
        if group and group != c.group:
            raise PatternError(f"{name} is in the group {c.group}, not {group}: {c.example}")
        if soft and name not in SOFT:
            raise PatternError(f"{{~{name}:...}}: only {', '.join(SOFT)} have a weighted form")
        if c.level == "predicate":
            return self.predicate(name, spec, colon, end, quoted)
        if c.argument == "literal":
            return self.check(Named(name, spec, self.text[colon + 1 : end].strip(), None, soft)), end + 1
        inner, stop = self.alternation(colon + 1, quoted or c.argument == "inner")
        self.close(stop, "}")
        if c.argument == "inner" and has_predicate(inner):
            raise PatternError(f"a predicate can't stand inside {{{name}...}}: the match is the edited string; write {{palindrome:{{{name}...}}}}")
        if stop == colon + 1:
            raise PatternError(f"{{{name}...}} needs a pattern: {c.example}")
        return self.check(Named(name, spec, self.text[colon + 1 : end], inner)), end + 1

    def packed(self, name: str, spec: str, colon: int, end: int, quoted: bool) -> tuple[Node, int]:
        if self.packs[name]["type"] == "substitution":
            return Named(name, spec, self.text[colon + 1 : end].strip()), end + 1
        inner, stop = self.alternation(colon + 1, quoted)
        self.close(stop, "}")
        return Named(name, spec, self.text[colon + 1 : end], inner), end + 1

    def predicate(self, name: str, spec: str, colon: int, end: int, quoted: bool) -> tuple[Node, int]:
        if name == "iso":
            cipher = " ".join(self.text[colon + 1 : end].lower().split())
            if spec or not re.fullmatch(r"[a-z ]+", cipher):
                raise PatternError("{iso:...} takes a text of letters and spaces, as in {iso:xjxj}")
            hull = seq([Char(CLASSES["A"] if c != " " else frozenset(" "), False) for c in cipher])
            return Pred("iso", "", hull, cipher), end + 1
        inner, stop = self.alternation(colon + 1, quoted)
        self.close(stop, "}")
        if stop == colon + 1:
            raise PatternError(f"{{{name} ...}} needs a pattern: {CATALOG[name].example}")
        if name in RELATIONS:
            m = re.fullmatch(r"(\d*)\s*([a-z][a-z0-9]*)\s*,\s*([a-z][a-z0-9]*)", spec)
            if not m or (m[1] and (name != "shift" or not 1 <= int(m[1]) <= 25)):
                raise PatternError(f"{{{name} ...}} takes two captures, as in {CATALOG[name].example}; a shift is 1 to 25")
            for capture in (m[2], m[3]):
                if not any(isinstance(x, Cap) and x.name == capture for x in walk(inner)):
                    raise PatternError(f'{{{name} ...}} names "{capture}", but nothing inside is captured as {{={capture}:...}}')
        elif name in ("palindrome", "reversible") and spec:
            raise PatternError(f"{name} takes nothing before the colon")
        elif name == "compound" and not re.fullmatch(r"[2-5]", spec):
            raise PatternError("{compound n:...} takes 2 to 5 pieces")
        elif name == "stress" and not re.fullmatch(r"[012]+", spec):
            raise PatternError("{stress ...} takes a text of 0 and 1")
        elif name == "syllables" and not (spec.isdigit() or count_range(spec)):
            raise PatternError("{syllables ...} takes a number or a comparison")
        elif name == "anagram" and not spec:
            raise PatternError("{anagram X:...} takes a list, a word or a pattern")
        node, twice = inner, name
        while isinstance(node, Pred):
            if node.name == twice and node.name not in RELATIONS:
                raise PatternError(f"{name} is applied twice")
            node = node.inner
        return Pred(name, spec, inner), end + 1

    def check(self, node: Named) -> Named:
        from lexigrid.functions.codes import check_named

        if (why := check_named(node)) is not None:
            raise PatternError(f"{{{node.name}{' ' + node.spec if node.spec else ''}:{node.text}}}: {why}; as in {CATALOG[node.name].example}")
        return node


def parse(text: str, packs: dict | None = None) -> Node:
    return Parser(text, packs).parse()


def conjuncts(node: Node) -> list[Node]:
    """The members of the outermost intersection."""
    return [x for part in node.parts for x in conjuncts(part)] if isinstance(node, And) else [node]
