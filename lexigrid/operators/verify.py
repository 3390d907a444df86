"""Exact check of predicates at any depth: a text is kept if some parse of it satisfies them all.

Runs in batches on the survivors of a query's hull, which are short texts. Relations compare captures without spaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.plans.automata import CODE, Dfa
from lexigrid.plans.build import Builder, constraints
from lexigrid.plans.catalog import RELATIONS
from lexigrid.plans.syntax import ALPHABET, LETTERS, Alt, Anagram, And, Cap, Char, Named, Node, Not, Pred, Rep, Seq, count_range, has_predicate, walk

#: Shares of all words that a word must have: as a backwards reading, and as a compound's piece.
REVERSAL_SHARE, PIECE_SHARE = 1e-6, 1e-5

Env = tuple[tuple[str, str], ...]
Found = set[tuple[int, Env, tuple[str, ...]]]


@dataclass
class Knowledge:
    """What verdicts look up: counts of known words (those above the lower share), their total, stress shapes, and the
    entries of anagrams' arguments."""

    words: dict[str, int] = field(default_factory=dict)
    total: int = 0
    stress: dict[str, str] = field(default_factory=dict)
    sets: dict[str, list[str]] = field(default_factory=dict)

    def knows(self, word: str, share: float) -> bool:
        count = self.words.get(word, 0)
        return count > 0 and count >= share * self.total


def best_split(word: str, pieces: int, known: Callable[[str], bool]) -> list[str] | None:
    """The cut into known words whose shortest is longest; ties go to the earliest cut, level by level."""
    if pieces == 1:
        return [word] if len(word) >= 2 and known(word) else None
    best, length = None, 0
    for cut in range(2, len(word) - 1):
        if known(word[:cut]) and (rest := best_split(word[cut:], pieces - 1, known)):
            shortest = min(cut, *map(len, rest))
            if shortest > length:
                best, length = [word[:cut], *rest], shortest
    return best


def isomorph(text: str, cipher: str) -> dict[str, str] | None:
    """The one-to-one letter mapping from cipher to text, spaces in the same places."""
    if len(text) != len(cipher):
        return None
    there, back = {}, {}
    for a, b in zip(cipher, text, strict=True):
        if (a == " ") != (b == " ") or (a != " " and (b not in LETTERS or there.setdefault(a, b) != b or back.setdefault(b, a) != a)):
            return None
    return there


def verdict(pred: Pred, text: str, env: dict[str, str], know: Knowledge) -> str | None:
    """The note of a predicate that holds of a text ("" for none), or None if it doesn't hold."""
    text = text.strip(" ")
    chars, name, spec = text.replace(" ", ""), pred.name, pred.spec
    if name == "palindrome":
        return "" if len(chars) >= 2 and chars == chars[::-1] else None
    if name == "reversible":
        back = chars[::-1]
        return f"← {back}" if back != chars and know.knows(back, REVERSAL_SHARE) else None
    if name == "compound":
        found = best_split(text, int(spec), lambda w: know.knows(w, PIECE_SHARE)) if " " not in text else None
        return "·".join(found) if found else None
    if name in ("syllables", "stress"):
        shapes = [know.stress.get(w) for w in text.split(" ")]
        if None in shapes:
            return None
        shape = "".join(shapes)
        if name == "stress":
            return "" if shape.replace("2", "1") == spec.replace("2", "1") else None
        low, high = (int(spec), int(spec)) if spec.isdigit() else count_range(spec)
        return f"{len(shape)} syll" if low <= len(shape) and (high is None or len(shape) <= high) else None
    if name == "anagram":
        key = sorted(chars)
        for e in know.sets[spec]:
            own = e.replace(" ", "")
            if own != chars and sorted(own) == key:
                return f"← {e}"
        return None
    if name == "iso":
        return "" if isomorph(text, pred.text) is not None else None
    first, second = (p.strip() for p in spec.lstrip("0123456789 ").split(","))
    if first not in env or second not in env:
        return None
    a, b = env[first].replace(" ", ""), env[second].replace(" ", "")
    if name == "eq":
        return "" if a == b else None
    if name == "rev":
        return "" if a == b[::-1] else None
    wanted = spec[: len(spec) - len(spec.lstrip("0123456789"))]
    if len(a) != len(b) or not a or set(a + b) - set(LETTERS):
        return None
    shifts = {(LETTERS.index(y) - LETTERS.index(x)) % 26 for x, y in zip(a, b, strict=True)}
    shift = shifts.pop()
    if shifts or not shift or (wanted and shift != int(wanted)):
        return None
    return "" if wanted else f"shift +{shift}"


class Verifier:
    def __init__(self, node: Node, builder: Builder, know: Knowledge):
        self.node, self.builder, self.know = node, builder, know
        self.automata: dict[int, list[Dfa]] = {}
        self._prepare(node)

    def __getstate__(self) -> tuple:
        order = {id(n): k for k, n in enumerate(walk(self.node))}
        return self.node, self.know, {order[k]: v for k, v in self.automata.items()}

    def __setstate__(self, state: tuple) -> None:
        self.node, self.know, numbered = state
        nodes, self.builder = list(walk(self.node)), None
        self.automata = {id(nodes[k]): v for k, v in numbered.items()}

    def _prepare(self, node: Node) -> None:
        """Compiles the automata of parts without predicates before the verifier is sent to executors."""
        if isinstance(node, Named):
            if node.inner is not None and has_predicate(node.inner):
                self.automata[id(node)] = [Dfa.of(n) for n in constraints(node)]
            else:
                self.automata[id(node)] = [self.builder.dfa(node)]
                return
        for child in node.children():
            self._prepare(child)

    def check(self, text: str) -> str | None:
        """The notes of the first parse in order that satisfies every predicate, or None."""
        self.text, self.memo = text, {}
        found = sorted(notes for end, _, notes in self.match(self.node, 0, ()) if end == len(text))
        return " ".join(dict.fromkeys(n for n in found[0] if n)) if found else None

    def match(self, node: Node, at: int, env: Env) -> Found:
        key = id(node), at, env
        if key not in self.memo:
            self.memo[key] = self._match(node, at, env)
        return self.memo[key]

    def _spaces(self, at: int) -> range:
        end = at
        while self.text[end : end + 1] == " ":
            end += 1
        return range(at, end + 1)

    def _match(self, node: Node, at: int, env: Env) -> Found:
        match node:
            case Char(chars, pad, optional):
                starts = self._spaces(at) if pad else (at,)
                mid = {s + 1 for s in starts if self.text[s : s + 1] in chars and s < len(self.text)} | (set(starts) if optional else set())
                return {(e, env, ()) for m in mid for e in (self._spaces(m) if pad else (m,))}
            case Seq(parts):
                return self._sequence(parts, at, env)
            case Alt(parts):
                return set().union(*(self.match(p, at, env) for p in parts))
            case And(parts):
                out = {(e, v, n) for e, v, n in self.match(parts[0], at, env)}
                for p in parts[1:]:
                    out = {(e, w, n + m) for e, v, n in out for f, w, m in self.match(p, at, v) if f == e}
                return out
            case Not(inner):
                ends = {e for e, _, _ in self.match(inner, at, env)}
                return {(e, env, ()) for e in range(at, len(self.text) + 1) if e not in ends}
            case Rep(inner, least, most):
                return self._repeat(inner, least, most, at, env)
            case Anagram(parts):
                return self._permuted(parts, at, env)
            case Cap(name, inner):
                return {(e, tuple(sorted({**dict(v), name: self.text[at:e]}.items())), n) for e, v, n in self.match(inner, at, env)}
            case Pred(inner=inner):
                out = set()
                for e, v, n in self.match(inner, at, env):
                    note = verdict(node, self.text[at:e], dict(v), self.know)
                    if note is not None:
                        out.add((e, v, (*n, note)))
                return out
            case Named():
                dfas = self.automata[id(node)]
                if node.inner is not None and has_predicate(node.inner):
                    return {x for x in self.match(node.inner, at, env) if all(d.accepts(self.text[at : x[0]]) for d in dfas)}
                return {(e, env, ()) for e in self._ends(dfas[0], at)}
        raise TypeError(node)

    def _ends(self, dfa: Dfa, at: int) -> set[int]:
        out, state = set(), 0
        for k in range(at, len(self.text) + 1):
            if dfa.accept[state]:
                out.add(k)
            if k == len(self.text) or self.text[k] not in CODE:
                break
            state = dfa.table[state, CODE[self.text[k]]]
            if state < 0:
                break
        return out

    def _sequence(self, parts: tuple[Node, ...], at: int, env: Env) -> Found:
        out: Found = {(at, env, ())}
        for p in parts:
            out = {(f, w, n + m) for e, v, n in out for f, w, m in self.match(p, e, v)}
        return out

    def _repeat(self, inner: Node, least: int, most: int | None, at: int, env: Env) -> Found:
        layer: Found = {(at, env, ())}
        out: Found = set(layer) if least == 0 else set()
        count = 0
        while layer and (most is None or count < most) and count <= max(least, len(self.text) + 1):
            count += 1
            layer = {(f, w, n + m) for e, v, n in layer for f, w, m in self.match(inner, e, v) if f > e or count <= least}
            if count >= least:
                out |= layer
        return out

    def _permuted(self, parts: tuple[Node, ...], at: int, env: Env) -> Found:
        if not parts:
            return {(at, env, ())}
        out: Found = set()
        for k, p in enumerate(parts):
            if p in parts[:k]:
                continue
            rest = parts[:k] + parts[k + 1 :]
            for e, v, n in self.match(p, at, env):
                out |= {(f, w, n + m) for f, w, m in self._permuted(rest, e, v)}
        return out


def verified(verifier: Verifier, text: Column) -> Column:
    """The note of a text that the verifier keeps, or null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(verifier.check)

    return run(text)


__all__ = ["ALPHABET", "RELATIONS", "Knowledge", "Verifier", "verdict", "verified"]
