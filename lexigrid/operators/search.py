"""Search: a pattern over a phrase table, as one DataFrame of (text, score, segments, note)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.dfa import steps
from lexigrid.operators import predicates as P
from lexigrid.operators.datasets import Datasets
from lexigrid.operators.verify import PIECE_SHARE, REVERSAL_SHARE, Knowledge, Verifier, verified
from lexigrid.plans.automata import CODE, Dfa
from lexigrid.plans.catalog import RELATIONS
from lexigrid.plans.lower import Lowered, Lowering
from lexigrid.plans.syntax import Node, PatternError, Pred, conjuncts, has_predicate, parse, walk
from lexigrid.sources.corpus import MAX_WORDS, load

#: What each further segment costs; strings that an anagram's argument may name.
RESTART, MOST_SET = 1e-6, 20_000
#: Patterns whose plans are kept; searches whose rows are kept.
PLANS, KEPT = 256, 8


class Engine:
    """A phrase table, its side datasets, and searches over both."""

    def __init__(self, table: DataFrame, data: Datasets | None = None, reverse: DataFrame | None = None, debris: bool = False, head: DataFrame | None = None):
        """reverse: the same rows sorted by rev, for patterns that fix only their end; head: the most frequent rows, for
        first pages."""
        self.table, self.data, self.reverse, self.debris, self.head = table, data or Datasets(), reverse, debris, head
        self.builder = self.data.builder()
        self.lowering = Lowering(self.builder)
        self._total: int | None = None
        self._widest: int | None = None
        self._plans: dict[str, tuple[Node, Lowered]] = {}
        self._kept: dict[tuple[Node, ...], DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, data: Datasets | None = None) -> Engine:
        """The engine of what ``corpus.store`` wrote."""
        return cls(load(spark, f"{path}/text"), data, load(spark, f"{path}/rev"), head=load(spark, f"{path}/head"))

    @property
    def widest(self) -> int:
        """The most words of a phrase in the table."""
        if self._widest is None:
            self._widest = self.table.agg(F.max("n_words")).first()[0] or 0
        return self._widest

    def planned(self, pattern: str | Node) -> tuple[Node, Lowered]:
        """The parsed pattern and its lowering, kept for later searches; an error if it needs longer phrases than there are."""
        if not isinstance(pattern, str):
            return pattern, self.lowering.query(pattern)
        if pattern not in self._plans:
            node = parse(pattern, self.data.packs)
            if " " in pattern or "{enum" in pattern or "{words" in pattern:
                needed = max((least_words(self.builder, m) for m in conjuncts(node)), default=1)
                if needed > MAX_WORDS and needed > self.widest:
                    raise PatternError(f"the pattern needs phrases of {needed} words, and the table holds phrases of up to {self.widest}; count it with max_words={needed}")
            if len(self._plans) >= PLANS:
                self._plans.pop(next(iter(self._plans)))
            self._plans[pattern] = node, self.lowering.query(node)
        return self._plans[pattern]

    def keep(self, pattern: str) -> DataFrame:
        """Keeps the rows that match a pattern's conditions: later patterns with all its members, and more, start from them."""
        node, plan = self.planned(pattern)
        rows = reduce(lambda d, c: d.where(c), plan.where, self.table).persist()
        if len(self._kept) >= KEPT:
            self._kept.pop(next(iter(self._kept))).unpersist()
        self._kept[tuple(conjuncts(node))] = rows
        return rows

    def _source(self, node: Node, plan: Lowered) -> DataFrame:
        members = conjuncts(node)
        for kept, rows in reversed(self._kept.items()):
            if all(m in members for m in kept):
                return rows
        return self.reverse if self.reverse is not None and "last letters, backwards" in plan.how else self.table

    @property
    def total(self) -> int:
        """Occurrences of all single words."""
        if self._total is None:
            self._total = self.table.where("n_words = 1").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0]
        return self._total

    # One segment.

    def matches(self, pattern: str | Node, source: DataFrame | None = None) -> DataFrame:
        """All rows of the table (or of source, rows of it) that match, with the weighted score and a note."""
        node, plan = self.planned(pattern)
        source = self._source(node, plan) if source is None else source
        df = reduce(lambda d, c: d.where(c), plan.where, source)
        notes: list[str] = []
        for member in conjuncts(node):
            df = self._predicates(df, member, notes)
        score = F.col("score").cast("double") * (plan.weight if plan.weight is not None else 1.0)
        note = F.concat_ws(" ", *(F.when(F.col(n) != "", F.col(n)) for n in notes)) if notes else F.lit("")
        return df.withColumn("score", score).withColumn("note", note).drop(*notes).where("score > 0")

    def _predicates(self, df: DataFrame, member: Node, notes: list[str]) -> DataFrame:
        """Native checks of predicates around a whole member; the exact parse for those further in."""
        node = member
        while isinstance(node, Pred) and node.name not in RELATIONS:
            note = f"_note{len(notes)}"
            notes.append(note)
            df = self._native(df, node, note)
            node = node.inner
        if has_predicate(node):
            note = f"_note{len(notes)}"
            notes.append(note)
            df = df.withColumn(note, verified(Verifier(node, self.builder, self.knowledge(node)), F.col("text"))).where(F.col(note).isNotNull())
        return df

    def _native(self, df: DataFrame, node: Pred, note: str) -> DataFrame:
        match node.name:
            case "palindrome":
                return P.palindrome(df, note)
            case "reversible":
                return P.reversible(df, note, self.table)
            case "compound":
                return P.compound(df, note, self.table, int(node.spec), self.debris)
            case "syllables":
                return P.syllables(df, note, self.data._loaded("syllables", "stress"), node.spec)
            case "stress":
                return P.stressed(df, note, self.data._loaded("stress", "stress"), node.spec)
            case "iso":
                return P.iso(df, note, node.text)
        entries = self.anagram_set(node.spec)
        rows = self.table.sparkSession.createDataFrame(list(enumerate(entries)), "pos int, entry string")
        return P.anagram_of(df, note, rows)

    def anagram_set(self, spec: str) -> list[str]:
        """The texts that an anagram's argument names: a list, else a pattern's, quoted if it can be."""
        import re

        if re.fullmatch(r"[a-z0-9 ]+", spec.strip(), re.I):
            try:
                return self.data.list(spec)
            except PatternError:
                pass
        for text in (f'"{spec}"', spec):
            try:
                node = parse(text, self.data.packs)
                members = [self.builder.dfa(m) for m in conjuncts(node)]
            except ValueError:
                continue
            listed = [(len(s), k, s) for k, d in enumerate(members) if (s := d.enumerate(MOST_SET)) is not None]
            if not listed:
                continue
            _, k, found = min(listed)
            found = [t for t in found if all(d.accepts(t) for j, d in enumerate(members) if j != k)]
            if has_predicate(node):
                check = Verifier(node, self.builder, self.knowledge(node))
                found = [t for t in found if check.check(t) is not None]
            return found
        raise PatternError(f'{{anagram ...}} needs a list, a word, or a pattern of at most {MOST_SET} texts, which "{spec}" is not')

    def knowledge(self, node: Node) -> Knowledge:
        """What the exact parse looks up. The counts are of words with at least a fixed share, so they are bounded by
        1 / share whatever the corpus; a pronouncing dictionary is as large as its language."""
        asked = {x.name for x in walk(node) if isinstance(x, Pred)}
        know = Knowledge(total=0)
        if asked & {"reversible", "compound"}:
            known = P.known_words(self.table, REVERSAL_SHARE if "reversible" in asked else PIECE_SHARE)
            know.words, know.total = {r[0]: r[1] for r in known.toLocalIterator()}, self.total
        if asked & {"syllables", "stress"}:
            know.stress = {r[0]: r[1] for r in self.data._loaded("stress", "stress").toLocalIterator()}
        for x in walk(node):
            if isinstance(x, Pred) and x.name == "anagram":
                know.sets[x.spec] = self.anagram_set(x.spec)
        return know

    # More segments.

    def product(self, node: Node) -> Dfa:
        """One automaton of the whole pattern: what the restart join steps through."""
        return reduce(Dfa.product, (self.builder.dfa(m) for m in conjuncts(node)))

    def chained(self, pattern: str | Node, segments: int = 2) -> DataFrame:
        """Matches of up to so many segments, each a row of the table; all but the last count by share and RESTART.

        A join on the automaton's state: rows that begin a match carry the state they reach, rows that may follow it the
        state they need. The language may hold longer chains; they are cut off at ``segments``.
        """
        node = parse(pattern, self.data.packs) if isinstance(pattern, str) else pattern
        if has_predicate(node):
            raise PatternError("a search of several segments takes no predicates")
        dfa, rows = self.product(node), self.table.select("text", F.col("score").cast("double").alias("score"))
        accepting = [int(k) for k in range(len(dfa.accept)) if dfa.accept[k]]
        ends = lambda df: df.where(F.col("target").isin(accepting))
        step = lambda sources, text: F.explode(steps(dfa, sources, text))
        whole = rows.select("text", "score", step([0], F.col("text")).alias("s")).select("text", "score", "s.target", F.lit(1).alias("segments"))
        out = [ends(whole)]
        scale = RESTART / max(self.total, 1)
        opened = rows.select("text", "score", step([0], F.concat("text", F.lit(" "))).alias("s")).select("text", (F.col("score") * scale).alias("score"), "s.target")
        live = [k for k in range(len(dfa.table))]
        for n in range(2, segments + 1):
            last = rows.select(F.col("text").alias("next"), F.col("score").alias("more"), step(live, F.col("text")).alias("s"))
            last = ends(last.select("next", "more", "s.source", "s.target")).select("next", "more", "source")
            met = opened.join(last, F.col("target") == F.col("source"))
            out.append(met.select(F.concat_ws(" ", "text", "next").alias("text"), (F.col("score") * F.col("more")).alias("score"), "target", F.lit(n).alias("segments")))
            if n < segments:
                more = rows.select(F.col("text").alias("next"), F.col("score").alias("more"), step(live, F.concat("text", F.lit(" "))).alias("s"))
                more = more.select("next", "more", "s.source", F.col("s.target").alias("to"))
                opened = opened.join(more, F.col("target") == F.col("source")).select(
                    F.concat_ws(" ", "text", "next").alias("text"), (F.col("score") * F.col("more") * scale).alias("score"), F.col("to").alias("target")
                )
        found = reduce(DataFrame.unionByName, out)
        return found.groupBy("text").agg(F.max(F.struct("score", -F.col("segments"))).alias("b")).select("text", "b.score", (-F.col("b.col2")).alias("segments"), F.lit("").alias("note"))

    # Results.

    def search(self, pattern: str | Node, k: int | None = 100, segments: int = 1, floor: float | None = None, after: tuple[float, str] | None = None) -> DataFrame:
        """The k best matches by falling score, then text. floor: the least share of the best score; after: the last
        (score, text) of the page before."""
        df = self.chained(pattern, segments) if segments > 1 else self.matches(pattern).select("text", "score", F.lit(1).alias("segments"), "note")
        if floor is not None:
            df = score_floor(df, floor)
        if after is not None:
            df = df.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("text") > after[1])))
        df = df.orderBy(F.desc("score"), "text")
        return df if k is None else df.limit(k)

    def first_page(self, pattern: str, k: int = 20) -> DataFrame:
        """The k best matches, from the head alone where it holds k and scores aren't weighted: then no other row beats them."""
        _, plan = self.planned(pattern)
        if self.head is not None and plan.weight is None:
            page = self.matches(pattern, self.head).select("text", "score", F.lit(1).alias("segments"), "note").orderBy(F.desc("score"), "text").limit(k)
            rows = page.collect()  # a page
            last = self.head.agg(F.min("score")).first()[0]
            if len(rows) == k and rows[-1]["score"] > last:  # phrases as frequent as the head's last may be missing from it
                return self.table.sparkSession.createDataFrame(rows, page.schema)
        return self.search(pattern, k)

    def probe(self, texts: list[str]) -> DataFrame:
        """(text, score, share) of given texts; those that the table lacks have 0."""
        asked = self.table.sparkSession.createDataFrame([(t,) for t in texts], "text string")
        found = asked.join(self.table.select("text", "score"), "text", "left").select("text", F.coalesce("score", F.lit(0)).cast("long").alias("score"))
        return found.withColumn("share", F.col("score") / float(max(self.total, 1)))


def least_words(builder, member: Node) -> int:
    """The fewest words of a text that a member accepts; 1 where its automaton can't be had."""
    try:
        dfa = builder.dfa(member)
    except ValueError:
        return 1
    space = CODE[" "]
    words, front, seen = 1, {0}, set()
    while front:
        todo = list(front)
        while todo:  # what is reached without a further space
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            todo += [int(t) for c, t in enumerate(dfa.table[at]) if t >= 0 and c != space and t not in seen]
        if any(dfa.accept[q] for q in seen):
            return words
        front = {int(dfa.table[q, space]) for q in seen if dfa.table[q, space] >= 0} - seen
        words += 1
    return 1


def lowered(pattern: str, data: Datasets | None = None) -> Lowered:
    data = data or Datasets()
    return Lowering(data.builder()).query(parse(pattern, data.packs))


def score_floor(df: DataFrame, floor: float) -> DataFrame:
    best = df.agg(F.max("score").alias("_best"))
    return df.join(F.broadcast(best), F.col("score") >= F.col("_best") * floor).drop("_best")  # one row is broadcast


def merged(engines: dict[str, Engine], pattern: str, k: int | None = 100) -> DataFrame:
    """(text, score, source) over several corpora: scores are scaled to the largest corpus, and the best of a text stays."""
    most = max(e.total for e in engines.values())
    each = [
        e.matches(pattern).select("text", (F.col("score") * (most / max(e.total, 1))).alias("score"), F.lit(name).alias("source"))
        for name, e in sorted(engines.items())
    ]
    both = reduce(DataFrame.unionByName, each)
    best = both.groupBy("text").agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), F.col("source"))).alias("source"))
    df = best.select("text", "score", "source").orderBy(F.desc("score"), "text")
    return df if k is None else df.limit(k)


def folded(df: DataFrame) -> DataFrame:
    """Of texts with the same letters in other spacing, the best."""
    best = df.groupBy(F.regexp_replace("text", " ", "").alias("_l")).agg(F.min_by("text", F.struct(-F.col("score"), F.col("text"))).alias("text"))
    return df.join(best.select("text"), "text", "left_semi")


def folded_page(rows: list, exempt: tuple[str, ...] = (), least: int = 12) -> list:
    """A page's rows without those that share a run of words of least or more characters with one before.

    Texts in exempt (the pattern's own words) don't count as shared.
    """
    shown: set[str] = set()
    out = []
    for row in rows:
        parts = row["text"].split(" ")
        runs = {" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}
        runs = {r for r in runs if len(r) >= least and r not in exempt}
        if not runs & shown:
            out.append(row)
            shown |= runs
    return out
