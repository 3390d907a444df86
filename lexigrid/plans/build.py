"""Syntax trees to automata, for every construct: the general way, where no native expression will do."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from lexigrid.functions import codes
from lexigrid.plans.automata import Dfa, Nfa, TooLarge
from lexigrid.plans.syntax import (
    ALPHABET, DIGITS, LETTERS, MOST_EDITS, Alt, Anagram, And, Cap, Char, Named, Node, Not, PatternError, Pred, Rep, Seq,
    count_range, has_predicate,
)

#: States of an automaton that is negated, and arcs of one that is edited.
MOST_NEGATED, MOST_EDIT_ARCS = 5_000, 800_000


def intersect(parts: list[Nfa]) -> Nfa:
    return reduce(Dfa.product, map(Dfa.of, parts)).nfa() if len(parts) > 1 else parts[0]


def constraints(node: Named) -> list[Nfa]:
    """The automata of a wrapping construct, to be intersected with its pattern's."""
    name, spec = node.name, node.spec
    ones = lambda chars: dict.fromkeys(chars, 1)
    if name in ("sum", "scrabble"):
        return [Nfa.counter({c: codes.value(name, c) for c in LETTERS}, *count_range(spec))]
    if name == "count":
        chars, rest = codes.set_and_range(spec)
        return [Nfa.counter(ones(codes.named_set(chars)), *count_range(rest))]
    if name == "letters":
        return [Nfa.counter(ones(LETTERS), *count_range(spec))]
    if name == "words":
        low, high = count_range(spec)
        return [Nfa.counter(ones(" "), max(0, low - 1), None if high is None else high - 1)] if high != 0 else [Nfa()]
    if name == "all":
        return [Nfa.counter(ones(c), 1, None) for c in codes.named_set(spec)]
    if name in ("distinct", "maxrep"):
        most = 1 if name == "distinct" else count_range(spec if not spec.isdigit() else f"={spec}")[1]
        return [Nfa.counter(ones(c), 0, most) for c in LETTERS]
    if name in ("sub", "bank"):
        counts = Counter(c for c in node.text.lower() if c != " ")
        bounds = [Nfa.counter(ones(c), *((0, n) if name == "sub" else (1, None))) for c, n in counts.items()]
        return [Nfa.loop("".join(counts) + " "), *bounds]
    if name == "elements":
        out = Nfa.repeat(Nfa.of_strings([*codes.ELEMENTS, " "]), 0, None)
        return [out]
    if name in ("ascending", "descending"):
        order = LETTERS if name == "ascending" else LETTERS[::-1]
        out = Nfa()
        at = [out.state() for _ in order]
        out.arc(0, " ", 0)
        out.finals = {0, *at}
        for k, c in enumerate(order):
            out.arc(0, c, at[k])
            out.arc(at[k], " ", at[k])
            for j in range(k, 26):
                out.arc(at[k], order[j], at[j])
        return [out]
    chars = codes.HOLES[int(spec.lstrip("= "))] if name == "holes" else codes.SHAPES[name]
    return [Nfa.loop(chars + " ")]


def cells(reading: codes.Cells) -> Nfa:
    out, at = Nfa(), 0
    for chars, skip in reading:
        to = out.state()
        out.arc(at, chars, to)
        if skip:
            out.arc(at, None, to)
        at = to
    out.finals = {at}
    return out


def edited(inner: Nfa, name: str, least: int, most: int, letters: str | None) -> Nfa:
    """Texts made from inner's by least to most edits, counted along the path of edits."""
    if not any(inner.arcs):
        raise PatternError(f"{{{name}:}} has nothing to edit")
    write = letters or LETTERS + DIGITS
    arcs = sum(map(len, inner.arcs))
    if arcs * (most + 1) * len(write) > MOST_EDIT_ARCS and name != "del":
        raise TooLarge("a pattern with too many edits")
    out, n = Nfa(), len(inner.arcs)
    out.arcs = [[] for _ in range(n * (most + 1))]
    for e in range(most + 1):
        for q, row in enumerate(inner.arcs):
            here, above = q + e * n, (e + 1) * n
            for c, t in row:
                out.arcs[here].append((c, t + e * n))
                if c < 0 or e == most:
                    continue
                if name in ("del", "edit") and (letters is None or ALPHABET[c] in letters):
                    out.arcs[here].append((-1, t + above))
                if name in ("subst", "edit"):
                    out.arc(here, "".join(w for w in write if w != ALPHABET[c]), t + above)
            if e < most and name in ("add", "edit"):
                out.arc(here, write, q + above)
    out.finals = {f + e * n for f in inner.finals for e in range(least, most + 1)}
    return out


class Builder:
    """entries: (name, spec, text) -> the texts of a word lookup; packs: constructs loaded for the session."""

    def __init__(self, entries=None, packs: dict | None = None):
        self.entries, self.packs = entries, packs or {}

    def dfa(self, node: Node) -> Dfa:
        return Dfa.of(self.nfa(node))

    def nfa(self, node: Node) -> Nfa:
        match node:
            case Char(chars, pad, optional):
                out = Nfa()
                end = out.state()
                out.arc(0, chars, end)
                if optional:
                    out.arc(0, None, end)
                if pad:
                    out.arc(0, " ", 0)
                    out.arc(end, " ", end)
                out.finals = {end}
                return out
            case Seq(parts):
                if not parts:
                    out = Nfa()
                    out.finals = {0}
                    return out
                return Nfa.concat([self.nfa(p) for p in parts])
            case Alt(parts):
                return Nfa.union([self.nfa(p) for p in parts])
            case And(parts):
                return intersect([self.nfa(p) for p in parts])
            case Not(inner):
                if has_predicate(inner):
                    return Nfa.loop(ALPHABET)  # a hull can't be negated: the verifier decides
                return Dfa.of(self.nfa(inner), MOST_NEGATED).complement().nfa()
            case Rep(inner, least, most):
                return Nfa.repeat(self.nfa(inner), least, most)
            case Anagram(parts):
                return intersect(self.anagram(parts))
            case Cap(_, inner):
                return self.nfa(inner)
            case Pred(_, _, inner):
                return self.nfa(inner)
            case Named():
                return self.named(node)
        raise TypeError(node)

    def anagram(self, parts: tuple[Node, ...]) -> list[Nfa]:
        """As many pieces as parts, and each part as often as it is written: separate conditions, not one permutation."""
        groups: list[list] = []  # [automaton, its minimal form, how often, holds a predicate]
        for part in parts:
            nfa = self.nfa(part)
            dfa, asks = Dfa.of(nfa), has_predicate(part)
            for g in groups:
                if not asks and not g[3] and g[1].equivalent(dfa):
                    g[2] += 1
                    break
            else:
                groups.append([nfa, dfa, 1, asks])
        total = sum(g[2] for g in groups)
        out = [Nfa.repeat(Nfa.union([g[0] for g in groups]), total, total)]
        for g in groups:
            rest = [x[0] for x in groups if x is not g]
            others = Nfa.repeat(Nfa.union(rest), 0, None) if rest else self.nfa(Seq(()))
            out.append(Nfa.concat([others, *([g[0], others] * g[2])]))
        return out

    def lookup(self, node: Named) -> list[str]:
        if self.entries is None:
            raise PatternError(f"{{{node.name}:...}} needs a dataset that isn't loaded")
        return self.entries(node.name, node.spec, node.text)

    def named(self, node: Named) -> Nfa:
        name = node.name
        if name in self.packs:
            from lexigrid.plans.packs import automata

            built = automata(self.packs[name], node)
            return built[0] if node.inner is None else intersect([self.nfa(node.inner), *built])
        if name in ("rhyme", "homo", "like", "near", "kind", "list"):
            if node.soft:
                return Nfa.loop(ALPHABET)
            return Nfa.of_strings(self.lookup(node))
        if name in ("del", "add", "subst", "edit"):
            least, most, letters, _ = codes.edit_spec(name, node.spec)
            return edited(self.nfa(node.inner), name, least, min(most, MOST_EDITS), letters)
        if name in ("morse", "a1z26"):
            steps, out = codes.splits(name, node.text), Nfa()
            last = max(b for _, b, _ in steps)
            for _ in range(last):
                out.state()
            for a, b, c in steps:
                out.arc(a, c, b)
            out.finals = {last}
            return out
        if name in ("sub", "bank"):
            return intersect(constraints(node))
        if node.inner is not None:
            return intersect([self.nfa(node.inner), *constraints(node)])
        return Nfa.union([cells(r) for r in codes.readings(name, node.spec, node.text)])
