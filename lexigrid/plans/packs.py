"""Construct packs: constructs that a session loads from JSON.

A pack is {"name": ..., "constructs": [{"name", "type", "summary", "letters" | "values" | "map"}]}. The types: letter-class
(only these letters), value-table (the letters' values sum to a number in a range), substitution (the literal text with
its letters replaced). A name may not be one of the language's own; of two packs with a name, the later holds.
"""

from __future__ import annotations

import json
import re

from lexigrid.plans.automata import Nfa
from lexigrid.plans.catalog import CATALOG
from lexigrid.plans.syntax import LETTERS, Named, PatternError, count_range

TYPES = {"letter-class": "letters", "value-table": "values", "substitution": "map"}


def load(*packs: str | dict) -> dict[str, dict]:
    """Constructs by name from packs, as JSON texts or read ones."""
    out: dict[str, dict] = {}
    for pack in packs:
        pack = json.loads(pack) if isinstance(pack, str) else pack
        for c in pack.get("constructs", ()):
            name, kind = c.get("name", ""), c.get("type")
            if not re.fullmatch(r"[a-z][a-z0-9]*", name):
                raise PatternError(f"pack {pack.get('name')}: {name!r} is no name for a construct")
            if name in CATALOG or name.rstrip("0123456789") in CATALOG:
                raise PatternError(f"pack {pack.get('name')}: {name} is one of the language's own constructs")
            if kind not in TYPES or not c.get(TYPES[kind]):
                raise PatternError(f"pack {pack.get('name')}: {name} needs a type of {', '.join(TYPES)} and its table")
            if kind == "letter-class" and set(c["letters"]) - set(LETTERS):
                raise PatternError(f"pack {pack.get('name')}: {name} may list lower-case letters only")
            out[name] = c
    return out


def automata(construct: dict, node: Named) -> list[Nfa]:
    kind = construct["type"]
    if kind == "letter-class":
        return [Nfa.loop(construct["letters"] + " ")]
    if kind == "value-table":
        got = count_range(node.spec)
        if got is None:
            raise PatternError(f"{{{node.name}...}} takes a comparison, as in {{{node.name}=10:A*}}")
        return [Nfa.counter(construct["values"], *got)]
    return [Nfa.of_strings(["".join(construct["map"].get(c, c) for c in node.text.lower())])]
