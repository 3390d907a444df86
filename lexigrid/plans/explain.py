"""Plans in words, contradictions, why a text matches, notes, and completion: all on the driver."""

from __future__ import annotations

import re
from itertools import combinations

from lexigrid.functions import codes
from lexigrid.functions.lists import LISTS
from lexigrid.operators.datasets import Datasets
from lexigrid.operators.verify import Knowledge, Verifier
from lexigrid.plans.catalog import CATALOG, SOFT, distance
from lexigrid.plans.lower import Lowering, bounds
from lexigrid.plans.syntax import LETTERS, Named, Node, PatternError, Pred, conjuncts, has_predicate, parse, walk

NEEDS = {"rhyme": "phonetic", "homo": "phonetic", "like": "thesaurus", "near": "neighbours", "kind": "sense", "syllables": "stress", "stress": "stress"}


def plan(pattern: str, data: Datasets | None = None) -> dict:
    """How a search would run: the form of each condition, the bounds, the datasets it needs, whether it can match."""
    data = data or Datasets()
    node = parse(pattern, data.packs)
    needs = sorted({NEEDS[x.name] for x in walk(node) if isinstance(x, (Named, Pred)) and x.name in NEEDS})
    missing = [n for n in needs if getattr(data, n) is None]
    out = {"pattern": pattern, "conjuncts": len(conjuncts(node)), "letters": bounds(node), "needs": needs, "missing": missing, "verifies": has_predicate(node)}
    if missing:
        return out
    builder = data.builder()
    lowered = Lowering(builder).query(node)
    why = conflict(node, builder)
    sizes = []
    for m in conjuncts(node):
        try:
            d = builder.dfa(m)
            sizes.append({"states": len(d.table), "finite": d.enumerate(5_000) is not None})
        except ValueError as e:
            sizes.append({"states": None, "finite": None, "why": str(e)})
    return {**out, "how": lowered.how, "weighted": lowered.weight is not None, "members": sizes, "empty": why is not None, "conflict": why, "segments": "one, unless asked for more: longer chains are cut off"}


def conflict(node: Node, builder) -> str | None:
    """The smallest contradiction: a member that matches nothing, or two that exclude each other."""
    members = []
    for m in conjuncts(node):
        try:
            members.append((m, builder.dfa(m)))
        except ValueError:
            continue
    for m, d in members:
        if d.empty:
            return f"{shown(m)} matches nothing"
    for (a, x), (b, y) in combinations(members, 2):
        try:
            if x.product(y).empty:
                return f"{shown(a)} and {shown(b)} exclude each other"
        except ValueError:
            continue
    return None


def shown(node: Node) -> str:
    """A node in short: constructs by name, the rest by kind."""
    if isinstance(node, (Named, Pred)):
        return f"{{{node.name}{' ' + node.spec if node.spec else ''}:{node.text or '...'}}}"
    low, high = bounds(node)
    return f"a {type(node).__name__.lower()} of {low}{'' if high == low else ' or more' if high is None else f' to {high}'} letters"


def reasons(pattern: str, text: str, data: Datasets | None = None, know: Knowledge | None = None) -> list[tuple[bool, str]]:
    """For each member of a pattern, whether a text satisfies it, and a sentence."""
    data = data or Datasets()
    builder = data.builder()
    out = []
    for m in conjuncts(parse(pattern, data.packs)):
        if has_predicate(m):
            note = Verifier(m, builder, know or Knowledge()).check(text)
            out.append((note is not None, f"{shown(m)}: {note or 'holds'}" if note is not None else f"{shown(m)} doesn't hold"))
            continue
        ok = builder.dfa(m).accepts(text)
        out.append((ok, _sentence(m, text) if ok else f"{shown(m)} doesn't accept it"))
    return out


def _sentence(node: Node, text: str) -> str:
    chars = text.replace(" ", "")
    if isinstance(node, Named):
        if node.name in ("sum", "scrabble"):
            return f"its values make {sum(codes.value(node.name, c) for c in chars)}"
        if node.name == "letters":
            return f"it has {sum(c in LETTERS for c in chars)} letters"
        if node.name == "words":
            return f"it has {text.count(' ') + 1} words"
        if node.name in ("caesar", "rot", "rot13"):
            shift = (LETTERS.index(chars[0]) - LETTERS.index(node.text.replace(" ", "")[0])) % 26
            return f"it is {node.text} shifted by {shift}"
        if node.name in ("del", "add", "subst", "edit"):
            return f"it is {node.text} edited: {edit_note(node.text.strip(chr(34)), text) or 'in several places'}"
        if node.name == "elements":
            return "it is spelled " + "·".join(element_split(chars) or [])
        return f"it is in {shown(node)}"
    return f"{shown(node)} accepts it"


def element_split(chars: str) -> list[str] | None:
    if not chars:
        return []
    for n in (2, 1):
        if chars[:n] in codes.ELEMENTS and (rest := element_split(chars[n:])) is not None and len(chars) >= n:
            return [chars[:n], *rest]
    return None


def edit_note(word: str, text: str) -> str | None:
    """The single edit from a word to a text: word −a, word +a, or word a→b."""
    if distance(word, text) != 1:
        return None
    at = next((k for k in range(min(len(word), len(text))) if word[k] != text[k]), min(len(word), len(text)))
    if len(word) > len(text):
        return f"{word} −{word[at]}"
    if len(word) < len(text):
        return f"{word} +{text[at]}"
    return f"{word} {word[at]}→{text[at]}"


def derived_note(pattern: str, text: str) -> str:
    """The note of a pattern that is one caesar or one edit of a word."""
    try:
        node = parse(pattern)
    except PatternError:
        return ""
    if isinstance(node, Named) and node.name == "caesar" and not node.spec:
        return f"shift +{(LETTERS.index(text.replace(' ', '')[0]) - LETTERS.index(node.text.lower().replace(' ', '')[0])) % 26}"
    if isinstance(node, Named) and node.name in ("del", "add", "subst", "edit") and re.fullmatch(r"[a-z]+", node.text.strip('"')):
        return edit_note(node.text.strip('"'), text) or ""
    return ""


def complete(pattern: str, cursor: int | None = None, data: Datasets | None = None) -> list[str]:
    """What may stand at the cursor: constructs after {, weighted ones after {~, lists after {list:."""
    head = pattern[: len(pattern) if cursor is None else cursor]
    if m := re.search(r"\{~?list:([a-z0-9 ]*)$", head):
        names = list(LISTS) + ([r[0] for r in data.lists.select("list").distinct().limit(1_000).collect()] if data and data.lists is not None else [])
        return sorted(n for n in names if n.startswith(m[1]))
    if m := re.search(r"\{(~?)([a-z0-9]*)$", head):
        names = SOFT if m[1] else [*CATALOG, *(data.packs if data else ())]
        return sorted((n for n in names if m[2] in n), key=lambda n: (not n.startswith(m[2]), n)) + ([] if m[1] or m[2] else ["=name"])
    return []


def syntax_help() -> str:
    """The language's constructs by group, with an example each."""
    groups: dict[str, list[str]] = {}
    for c in CATALOG.values():
        groups.setdefault(c.group, []).append(f"  {c.example}  {c.summary}")
    return "\n".join(f"{g}\n" + "\n".join(rows) for g, rows in groups.items())


def shown_score(score: float) -> str:
    """A score in at most eight digits."""
    return f"{score:.8g}"
