"""Automata over the 37 characters of phrases: built and minimised on the driver, run in batches on the executors."""

from __future__ import annotations

from collections import deque

import numpy as np

from lexigrid.plans.syntax import ALPHABET

SIZE = len(ALPHABET)
CODE = {c: k for k, c in enumerate(ALPHABET)}
MOST_STATES = 50_000


class TooLarge(ValueError):
    """A pattern part whose automaton passes the bound on states."""


class Nfa:
    """States 0..n-1; start 0; arcs[q] holds (code, to), code -1 for none."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[int, int]]] = [[]]
        self.finals: set[int] = set()

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, a: int, chars: str | frozenset[str] | None, b: int) -> None:
        self.arcs[a] += [(-1, b)] if chars is None else [(CODE[c], b) for c in chars]

    def include(self, other: Nfa) -> int:
        """Copies other's states; returns the number of its start."""
        shift = len(self.arcs)
        self.arcs += [[(c, t + shift) for c, t in row] for row in other.arcs]
        return shift

    @staticmethod
    def concat(parts: list[Nfa]) -> Nfa:
        out = Nfa()
        ends = {0}
        for part in parts:
            start = out.include(part)
            for e in ends:
                out.arc(e, None, start)
            ends = {f + start for f in part.finals}
        out.finals = ends
        return out

    @staticmethod
    def union(parts: list[Nfa]) -> Nfa:
        out = Nfa()
        for part in parts:
            start = out.include(part)
            out.arc(0, None, start)
            out.finals |= {f + start for f in part.finals}
        return out

    @staticmethod
    def repeat(one: Nfa, least: int, most: int | None) -> Nfa:
        parts = [one] * least
        if most is None:
            star = Nfa()
            start = star.include(one)
            star.arc(0, None, start)
            for f in one.finals:
                star.arc(f + start, None, 0)
            star.finals = {0}
            return Nfa.concat([*parts, star])
        for _ in range(most - least):
            maybe = Nfa.union([one])
            maybe.finals = maybe.finals | {0}
            parts.append(maybe)
        return Nfa.concat(parts)

    @staticmethod
    def of_strings(entries: list[str]) -> Nfa:
        """A prefix tree of exact texts."""
        out = Nfa()
        seen: dict[tuple[int, str], int] = {}
        for text in entries:
            at = 0
            for c in text:
                if (at, c) not in seen:
                    seen[at, c] = out.state()
                    out.arc(at, c, seen[at, c])
                at = seen[at, c]
            out.finals.add(at)
        return out

    @staticmethod
    def loop(chars: str) -> Nfa:
        out = Nfa()
        out.arc(0, chars, 0)
        out.finals = {0}
        return out

    @staticmethod
    def counter(values: dict[str, int], least: int, most: int | None) -> Nfa:
        """Texts whose characters' values sum to a number in the range; other characters are free."""
        top = least if most is None else most
        out = Nfa()
        for _ in range(top):
            out.state()
        for n in range(top + 1):
            for c in ALPHABET:
                to = n + values.get(c, 0)
                if to <= top or most is None:
                    out.arc(n, c, min(to, top))
        out.finals = set(range(least, top + 1))
        return out

    def reversed(self) -> Nfa:
        out = Nfa()
        shift = 1
        out.arcs += [[] for _ in self.arcs]
        for a, row in enumerate(self.arcs):
            for c, b in row:
                out.arcs[b + shift].append((c, a + shift))
        for f in self.finals:
            out.arc(0, None, f + shift)
        out.finals = {shift}
        return out


class Dfa:
    """table[state, code] is the next state or -1; accept[state]; start 0."""

    def __init__(self, table: np.ndarray, accept: np.ndarray):
        self.table, self.accept = table, accept

    @staticmethod
    def of(nfa: Nfa, most: int = MOST_STATES) -> Dfa:
        """Subset construction."""
        closed: dict[int, frozenset[int]] = {}

        def closure(q: int) -> frozenset[int]:
            if q not in closed:
                found, todo = {q}, [q]
                while todo:
                    for c, t in nfa.arcs[todo.pop()]:
                        if c < 0 and t not in found:
                            found.add(t)
                            todo.append(t)
                closed[q] = frozenset(found)
            return closed[q]

        start = closure(0)
        ids, rows, accept, todo = {start: 0}, [], [], deque([start])
        while todo:
            states = todo.popleft()
            to: dict[int, set[int]] = {}
            for q in states:
                for c, t in nfa.arcs[q]:
                    if c >= 0:
                        to.setdefault(c, set()).update(closure(t))
            row = [-1] * SIZE
            for c, target in to.items():
                key = frozenset(target)
                if key not in ids:
                    if len(ids) >= most:
                        raise TooLarge(f"an automaton of over {most} states")
                    ids[key] = len(ids)
                    todo.append(key)
                row[c] = ids[key]
            rows.append(row)
            accept.append(not nfa.finals.isdisjoint(states))
        return Dfa(np.array(rows, np.int32).reshape(-1, SIZE), np.array(accept, bool)).trimmed()

    def nfa(self) -> Nfa:
        out = Nfa()
        out.arcs = [[(c, int(t)) for c, t in enumerate(row) if t >= 0] for row in self.table]
        out.finals = set(np.flatnonzero(self.accept).tolist())
        return out

    def live(self) -> np.ndarray:
        """Whether an accepting state can be reached from each state."""
        live = self.accept.copy()
        while True:
            to = np.where(self.table >= 0, live[np.maximum(self.table, 0)], False).any(axis=1) | live
            if (to == live).all():
                return live
            live = to

    def trimmed(self) -> Dfa:
        """Minimal: dead states dropped, equivalent ones merged by refining classes until stable."""
        live = self.live()
        table = np.where((self.table >= 0) & live[np.maximum(self.table, 0)], self.table, -1)
        group, count = self.accept.astype(np.int64) + 1, 0
        while True:
            rows = np.column_stack([group, np.where(table >= 0, group[np.maximum(table, 0)], 0)])
            _, group = np.unique(rows, axis=0, return_inverse=True)
            group = group.reshape(-1) + 1
            if group.max() == count:
                break
            count = int(group.max())
        # number the classes from the start outwards
        order, todo = {int(group[0]): 0}, deque([int(group[0])])
        member = {int(g): k for k, g in reversed(list(enumerate(group)))}
        out = []
        while todo:
            row = [-1] * SIZE
            for c, t in enumerate(table[member[todo.popleft()]]):
                if t >= 0:
                    g = int(group[t])
                    if g not in order:
                        order[g] = len(order)
                        todo.append(g)
                    row[c] = order[g]
            out.append(row)
        accept = np.array([self.accept[member[g]] for g in order], bool)
        return Dfa(np.array(out, np.int32).reshape(-1, SIZE), accept)

    def complement(self) -> Dfa:
        n = len(self.table)
        table = np.vstack([np.where(self.table < 0, n, self.table), np.full((1, SIZE), n, np.int32)]).astype(np.int32)
        return Dfa(table, np.append(~self.accept, True)).trimmed()

    def product(self, other: Dfa, most: int = MOST_STATES) -> Dfa:
        ids, todo, rows, accept = {(0, 0): 0}, deque([(0, 0)]), [], []
        while todo:
            a, b = todo.popleft()
            row = [-1] * SIZE
            both = (self.table[a] >= 0) & (other.table[b] >= 0)
            for c in np.flatnonzero(both).tolist():
                key = int(self.table[a, c]), int(other.table[b, c])
                if key not in ids:
                    if len(ids) >= most:
                        raise TooLarge(f"an automaton of over {most} states")
                    ids[key] = len(ids)
                    todo.append(key)
                row[c] = ids[key]
            rows.append(row)
            accept.append(bool(self.accept[a] and other.accept[b]))
        return Dfa(np.array(rows, np.int32).reshape(-1, SIZE), np.array(accept, bool)).trimmed()

    def equivalent(self, other: Dfa) -> bool:
        return self.table.shape == other.table.shape and bool((self.table == other.table).all() and (self.accept == other.accept).all())

    def accepts(self, text: str) -> bool:
        at = 0
        for c in text:
            at = self.table[at, CODE[c]] if c in CODE and at >= 0 else -1
        return at >= 0 and bool(self.accept[at])

    @property
    def empty(self) -> bool:
        return not self.accept.any()

    def enumerate(self, cap: int) -> list[str] | None:
        """All texts, or None where there are more than cap or infinitely many."""
        out, todo = [], deque([(0, "")])
        n = len(self.table)
        while todo:
            at, text = todo.popleft()
            if len(text) > n or len(todo) > 4 * cap:
                return None  # longer than the automaton has states: a cycle
            if self.accept[at]:
                out.append(text)
                if len(out) > cap:
                    return None
            todo.extend((int(t), text + ALPHABET[c]) for c, t in enumerate(self.table[at]) if t >= 0)
        return sorted(out)

    def lengths(self, most: int = 40) -> tuple[int, int | None]:
        """The shortest and longest text's length, the longest None beyond most."""
        at, short, long_ = {0}, None, 0
        for k in range(most + 1):
            if any(self.accept[q] for q in at):
                short, long_ = k if short is None else short, k
            at = {int(t) for q in at for t in self.table[q] if t >= 0}
        return short or 0, None if at else long_

    def run(self, codes: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
        """States after rows of character codes (-1 pads the end, -2 is no character), from the start states; -1 dead."""
        table = np.vstack([self.table, np.full((1, SIZE), -1, np.int32)])
        state = np.full(len(codes), start, np.int64) if np.isscalar(start) else start.astype(np.int64)
        for k in range(codes.shape[1]):
            c = codes[:, k]
            state = np.where(c == -1, state, np.where(c == -2, -1, table[state, np.maximum(c, 0)]))
        return state


def encode(texts: list[str]) -> np.ndarray:
    """Rows of character codes, padded with -1; -2 for characters outside the alphabet."""
    width = max(map(len, texts), default=0)
    lookup = np.full(1 << 16, -2, np.int16)
    for c, k in CODE.items():
        lookup[ord(c)] = k
    out = np.full((len(texts), width), -1, np.int16)
    for row, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        out[row, : len(points)] = lookup[np.minimum(points, 0xFFFF)]
    return out
