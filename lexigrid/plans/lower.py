"""Syntax trees to Column expressions over a phrase table.

A conjunct becomes one boolean expression. Regular patterns become a Java regular expression on the letters (where no
atom can hold a space) or on the text; counting, bag and shape constructs become closed forms; small finite languages
become IN lists, which Parquet readers push down; what is left runs as an automaton in batches. Bounds that follow from
the tree (letters, words, first characters) are added as plain comparisons, which prune before anything costly.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import codes
from lexigrid.functions.dfa import accepts
from lexigrid.plans.automata import Dfa
from lexigrid.plans.build import Builder
from lexigrid.plans.syntax import (
    ALPHABET, LETTERS, Alt, And, Anagram, Cap, Char, Named, Node, Not, Pred, Rep, Seq, conjuncts, count_range, has_predicate, walk,
)

#: Finite languages up to so many texts become IN lists.
MOST_LISTED = 5_000
SOFT_MISS = 0.01


@dataclass
class Lowered:
    """where: conditions; weight: what multiplies the score; how: a name for each condition's form, for explain."""

    where: list[Column] = field(default_factory=list)
    weight: Column | None = None
    how: list[str] = field(default_factory=list)

    def add(self, how: str, *where: Column) -> None:
        self.where += where
        self.how.append(how)

    def times(self, weight: Column) -> None:
        self.weight = weight if self.weight is None else self.weight * weight


def _class(chars: frozenset[str]) -> str:
    if len(chars) == 1:
        return re.escape(next(iter(chars)))
    return "[" + re.sub(r"abcdefghijklmnopqrstuvwxyz", "a-z", re.sub("0123456789", "0-9", "".join(sorted(chars)))) + "]" if chars else "(?!)"


def regex(node: Node, builder: Builder, padded: bool = True) -> str | None:
    """A regular expression of the node's language, or None if it has parts that only automata can say.

    With padded False the atoms' spaces are left out, for matching letters.
    """
    match node:
        case Char(chars, pad, optional):
            one = _class(chars) + ("?" if optional else "")
            return f" *{one} *" if pad and padded else one
        case Seq(parts) | Alt(parts):
            inner = [regex(p, builder, padded) for p in parts]
            if None in inner:
                return None
            joined = ("|" if isinstance(node, Alt) else "").join(inner)
            return f"(?:{joined})"
        case Rep(inner, least, most):
            one = regex(inner, builder, padded)
            return one and f"(?:{one}){{{least},{'' if most is None else most}}}"
        case Cap(_, inner) | Pred(_, _, inner):
            return regex(inner, builder, padded)
        case Named(name, spec, text, None, False):
            if name in builder.packs or name in ("morse", "a1z26", "sub", "bank"):
                return None
            if name in ("rhyme", "homo", "like", "near", "kind", "list"):
                found = builder.lookup(node)
                return "(?:" + "|".join(map(re.escape, found)) + ")" if 0 < len(found) <= 200 else None
            readings = codes.readings(name, spec, text)
            return "(?:" + "|".join("".join(_class(frozenset(c)) + "?" * skip for c, skip in r) for r in readings) + ")"
    return None


def _free(node: Node) -> bool:
    """Whether spaces may stand anywhere in a text of the node, so that only its letters matter."""
    return all(
        (isinstance(x, Char) and x.pad and not x.optional and " " not in x.chars) or isinstance(x, (Seq, Alt, Rep, Cap, Pred))
        for x in walk(node)
    )


def bounds(node: Node) -> tuple[int, int | None]:
    """The least and most letters and digits in a text of the node."""
    match node:
        case Char(chars, _, optional):
            return (0 if optional or chars == {" "} else int(" " not in chars)), int(chars != {" "})
        case Anagram(parts) if not all(isinstance(p, Char) for p in parts):
            both = [bounds(p) for p in parts]  # each piece may be any of the parts
            return len(parts) * min(a for a, _ in both), None if any(b is None for _, b in both) else len(parts) * max(b for _, b in both)
        case Seq(parts) | Anagram(parts):
            both = [bounds(p) for p in parts]
            return sum(a for a, _ in both), None if any(b is None for _, b in both) else sum(b for _, b in both)
        case Alt(parts):
            both = [bounds(p) for p in parts]
            return min(a for a, _ in both), None if any(b is None for _, b in both) else max(b for _, b in both)
        case And(parts):
            both = [bounds(p) for p in parts]
            most = [b for _, b in both if b is not None]
            return max(a for a, _ in both), min(most) if most else None
        case Rep(inner, least, most):
            a, b = bounds(inner)
            return a * least, None if most is None or b is None else b * most
        case Cap(_, inner) | Pred(_, _, inner):
            return bounds(inner)
        case Named(name, _, _, inner, False) if inner is not None and name not in ("del", "add", "subst", "edit"):
            return bounds(inner)
    return 0, None


def literal(node: Node, end: bool = False) -> str:
    """The letters that every text of the node begins with, or ends with (spaces aside)."""
    match node:
        case Char(chars, _, False) if len(chars) == 1 and " " not in chars:
            return next(iter(chars))
        case Seq(parts):
            out = ""
            for p in reversed(parts) if end else parts:
                own = literal(p, end)
                out = own + out if end else out + own
                if not isinstance(p, Char) or not own:
                    break
            return out
        case Rep(inner, least, _) if least > 0:
            return literal(inner, end) if isinstance(inner, Char) else ""
        case Cap(_, inner) | Pred(_, _, inner):
            return literal(inner, end)
    return ""


def between(value: Column, least: int, most: int | None) -> Column:
    return value >= least if most is None else value == least if least == most else value.between(least, most)


def _only(chars: str) -> Column:
    return F.col("letters").rlike(f"^{_class(frozenset(chars))}*$")


def wrapped(node: Named) -> Column:
    """The closed form of a counting, bag or shape construct's own condition."""
    name, spec = node.name, node.spec
    if name == "sum":
        value = F.expr("aggregate(split(letters, ''), 0, (s, c) -> s + if(c between 'a' and 'z', ascii(c) - 96, 0))")
        return between(value, *count_range(spec))
    if name == "scrabble":
        tiers = [(v, "".join(c for c in LETTERS if codes.value("scrabble", c) == v)) for v in sorted(set(codes.SCRABBLE.values()))]
        value = reduce(lambda a, b: a + b, (F.lit(v) * _count(chars) for v, chars in tiers))
        return between(value, *count_range(spec))
    if name == "count":
        chars, rest = codes.set_and_range(spec)
        return between(_count(codes.named_set(chars)), *count_range(rest))
    if name == "letters":
        return between(_count(LETTERS), *count_range(spec))
    if name == "words":
        return between(F.col("n_words"), *count_range(spec))
    if name == "all":
        return reduce(lambda a, b: a & b, (F.col("letters").contains(c) for c in codes.named_set(spec)))
    if name in ("distinct", "maxrep"):
        most = 1 if name == "distinct" else count_range(spec if not spec.isdigit() else f"={spec}")[1]
        return ~F.col("sort_key").rlike(rf"([a-z])\1{{{most}}}")
    if name in ("sub", "bank"):
        counts = Counter(c for c in node.text.lower() if c != " ")
        each = [~F.col("sort_key").contains(c * (n + 1)) if name == "sub" else F.col("letters").contains(c) for c, n in counts.items()]
        return reduce(lambda a, b: a & b, each, _only("".join(counts)))
    if name == "elements":
        return F.col("text").rlike("^(?:" + "|".join(sorted(set(codes.ELEMENTS), key=lambda e: (-len(e), e))) + "| )*$")
    if name == "ascending":
        return _only(LETTERS) & (F.col("letters") == F.col("sort_key"))
    if name == "descending":
        return _only(LETTERS) & (F.col("rev") == F.col("sort_key"))
    return _only(codes.HOLES[int(spec.lstrip("= "))] if name == "holes" else codes.SHAPES[name])


def _count(chars: str) -> Column:
    return F.length("letters") - F.length(F.regexp_replace("letters", _class(frozenset(chars)), ""))


def _plain_word(node: Node) -> str | None:
    """The text of a node that is one word written out."""
    parts = node.parts if isinstance(node, Seq) else (node,)
    if parts and all(isinstance(p, Char) and not p.pad and not p.optional and len(p.chars) == 1 and " " not in p.chars for p in parts):
        return "".join(next(iter(p.chars)) for p in parts)
    return None


class Lowering:
    def __init__(self, builder: Builder):
        self.builder = builder

    def query(self, node: Node) -> Lowered:
        """The search of a whole pattern; predicates stand as their hulls."""
        out = Lowered()
        low, high = bounds(node)
        if low > 1 or high is not None:
            out.add("letters bound", between(F.col("n_letters"), low, high))
        for part in conjuncts(node):
            self.conjunct(part, out)
        return out

    def conjunct(self, node: Node, out: Lowered) -> None:
        first, last = literal(node), literal(node, end=True)
        if first:
            out.add("first letters", F.col("text").startswith(first[:1]), F.col("letters").startswith(first))
        elif len(last) >= 2:
            out.add("last letters, backwards", F.col("rev").startswith(last[::-1]))
        if isinstance(node, Named) and node.soft:
            out.how.append("weights")
            out.times(self.soft(node))
            return
        if isinstance(node, Named) and node.name == "edit" and codes.edit_spec("edit", node.spec)[3]:
            self.graded(node, out)
            return
        out.add(*self.condition(node))

    def condition(self, node: Node) -> tuple[str, Column]:
        """A form and an expression for whether the text is in the node's language."""
        match node:
            case And(parts):
                both = [self.condition(p) for p in parts]
                return " and ".join(h for h, _ in both), reduce(lambda a, b: a & b, (c for _, c in both))
            case Alt(parts) if regex(node, self.builder) is None:
                both = [self.condition(p) for p in parts]
                return " or ".join(h for h, _ in both), reduce(lambda a, b: a | b, (c for _, c in both))
            case Not(inner):
                if has_predicate(inner):
                    return "anything", F.lit(True)
                how, cond = self.condition(inner)
                return f"not {how}", ~cond
            case Cap(_, inner) | Pred(_, _, inner):
                return self.condition(inner)
            case Anagram(parts) if all(isinstance(p, Char) and len(p.chars) == 1 and not p.optional and " " not in p.chars for p in parts):
                key = "".join(sorted(next(iter(p.chars)) for p in parts))
                cond = F.col("sort_key") == key
                return "sorted letters", cond if all(p.pad for p in parts) else cond & (F.col("n_words") == 1)
            case Named():
                return self.named(node)
        if _free(node):
            return "regex on letters", F.col("letters").rlike(f"^{regex(node, self.builder, padded=False)}$")
        found = regex(node, self.builder)
        if found is not None:
            return "regex on text", F.col("text").rlike(f"^{found}$")
        return self.automaton(self.builder.dfa(node))

    def automaton(self, dfa: Dfa) -> tuple[str, Column]:
        if dfa.empty:
            return "empty", F.lit(False)
        listed = dfa.enumerate(MOST_LISTED)
        if listed is not None:
            return f"list of {len(listed)}", F.col("text").isin(listed)
        return f"automaton of {len(dfa.table)} states", accepts(dfa, F.col("text"))

    def named(self, node: Named) -> tuple[str, Column]:
        name = node.name
        if name in self.builder.packs:
            return self.automaton(self.builder.dfa(node))
        if node.soft:
            return "anything", F.lit(True)
        if name in ("rhyme", "homo", "like", "near", "kind", "list"):
            found = self.builder.lookup(node)
            return f"list of {len(found)}", F.col("text").isin(found) if found else F.lit(False)
        if name == "morse":
            code = re.sub(r"\s+", "", node.text)
            table = F.create_map(*(F.lit(x) for pair in codes.MORSE.items() for x in pair))
            spelled = F.array_join(F.transform(F.split("text", ""), lambda c: F.coalesce(table[c], F.lit("?"))), "")
            return "encoded letters", spelled == code
        if name in ("sub", "bank"):
            return name, wrapped(node)
        if name in ("del", "add", "subst", "edit"):
            return self.edit(node)
        if node.inner is not None:
            how, cond = self.condition(node.inner)
            return f"{how} and {name}", cond & wrapped(node)
        if name != "a1z26":
            return "regex on text", F.col("text").rlike(f"^{regex(node, self.builder)}$")
        return self.automaton(self.builder.dfa(node))

    def edit(self, node: Named) -> tuple[str, Column]:
        least, most, letters, _ = codes.edit_spec(node.name, node.spec)
        word = _plain_word(node.inner)
        if node.name == "edit" and word and least == 0 and letters is None:
            # edits never write a space, so only single words are near a word
            return "edit distance", (F.col("n_words") == 1) & (F.levenshtein(F.col("text"), F.lit(word), most) >= 0)
        return self.automaton(self.builder.dfa(node))

    def graded(self, node: Named, out: Lowered) -> None:
        _, most, letters, _ = codes.edit_spec(node.name, node.spec)
        word = _plain_word(node.inner)
        if word and letters is None:
            near = F.levenshtein(F.col("text"), F.lit(word), most)
            out.add("edit distance", F.col("n_words") == 1, near >= 0)
            weight = F.lit(1.0)
            for e in range(1, most + 1):
                weight = F.when(near == e, float(f"1e-{12 * e}")).otherwise(weight)
            out.times(weight)
            return
        from lexigrid.plans.build import edited

        inner = self.builder.nfa(node.inner)
        weight = F.lit(0.0)
        for e in reversed(range(most + 1)):
            dfa = Dfa.of(edited(inner, "edit", e, max(e, 1), letters) if e else inner)
            weight = F.when(accepts(dfa, F.col("text")), F.lit(float(f"1e-{12 * e}"))).otherwise(weight)
        out.add("graded automata", weight > 0)
        out.times(weight)

    def soft(self, node: Named) -> Column:
        found = self.builder.lookup(node)
        if node.name != "near":
            return F.when(F.col("text").isin(found), 1.0).otherwise(SOFT_MISS)
        weight = F.lit(SOFT_MISS)
        for rank, text in reversed(list(enumerate(found))):
            weight = F.when(F.col("text") == text, max(0.05, 0.9**rank)).otherwise(weight)
        return weight


__all__ = ["ALPHABET", "Lowered", "Lowering", "bounds", "literal", "regex", "wrapped"]
