"""Side datasets of the word lookups: readers, builders, and the lookups themselves.

Schemas: phonetic(kind 'R' or 'H', group_id, word), stress(word, shape), thesaurus(group_id, word),
sense(sense_id, name), edge(parent, child), neighbours(word, rank, neighbour), lists(list, pos, entry).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions.lists import ALIASES, LISTS
from lexigrid.functions.text import entry
from lexigrid.plans.catalog import distance
from lexigrid.plans.syntax import PatternError

#: Bounds: names under one kind, entries of a list that isn't built in, neighbours by default.
MOST_KIND, MOST_LIST, NEIGHBOURS = 4_000, 20_000, 32


# Readers of the text formats.


def read_phonetics(spark: SparkSession, path: str) -> DataFrame:
    """Lines "R word word ..." (rhymes) or "H word word ..." (homophones), a group each."""
    rows = spark.read.text(path).withColumn("group_id", F.xxhash64("value")).withColumn("w", F.split("value", " "))
    return rows.where(F.col("w")[0].isin("R", "H")).select(F.col("w")[0].alias("kind"), "group_id", F.explode(F.expr("slice(w, 2, size(w) - 1)")).alias("word"))


def read_stress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="word string, shape string")


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """A sense group a line, tab-separated."""
    rows = spark.read.text(path)
    return rows.select(F.xxhash64("value").alias("group_id"), F.explode(F.split("value", "\t")).alias("word"))


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sense, edge) from lines "name|name<TAB>child,child", where a line's number from 0 is its sense's id.

    The numbering needs the file in order: it is one bounded file, read by one task.
    """
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("sense_id", "line"))
    parts = rows.select("sense_id", F.split("line", "\t").alias("p"))
    sense = parts.select("sense_id", F.explode(F.split(F.col("p")[0], r"\|")).alias("name"))
    edge = parts.where("size(p) > 1 and p[1] <> ''").select(F.col("sense_id").alias("parent"), F.explode(F.split(F.col("p")[1], ",")).alias("child"))
    return sense, edge.withColumn("child", F.col("child").cast("int"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines "slug<TAB>subject<TAB>entry,entry"."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) = 3")
    return rows.select(F.col("p")[0].alias("list"), F.posexplode(F.split(F.col("p")[2], ",")).alias("pos", "entry"))


def remote_list(spark: SparkSession, path: str, url: str) -> DataFrame:
    """A list registered under its URL: an entry a line, # begins a comment."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    kept = rows.select(F.lit(url).alias("list"), "pos", entry(F.regexp_replace("line", "#.*", "")).alias("entry"))
    return kept.where(F.col("entry") != "").orderBy("pos").limit(MOST_LIST + 1)  # one too many, so that the lookup refuses it


def read_senses(spark: SparkSession, path: str, files: str = "data.*") -> DataFrame:
    """(key, words, below) from the files data.noun, data.verb, data.adj and data.adv of a lexical database's folder.

    A line is "offset file pos count word id ... pointers symbol offset pos nn ... | gloss", the words' count in hex; the
    licence above is indented. key is "pos:offset", below the keys that a pointer "~" leads to.
    """
    rows = spark.read.option("pathGlobFilter", files).text(path).where("value <> '' and value not like ' %'")
    f = F.split(F.substring_index("value", " | ", 1), " ")
    parsed = rows.select(f.alias("f"), F.conv(F.get(f, F.lit(3)), 16, 10).cast("int").alias("n")).where("n > 0")
    at = F.col("n") * 2 + 4
    links = F.coalesce(F.get("f", at).try_cast("int"), F.lit(0))
    every = lambda count, width, first: F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda i: first + i * width)
    names = F.transform(every(F.col("n"), 2, F.lit(4)), lambda k: entry(F.regexp_replace(F.get("f", k), r"\(\w+\)$", "")))
    down = F.filter(every(links, 4, at + 1), lambda k: F.get("f", k) == "~")
    below = F.transform(down, lambda k: F.concat_ws(":", F.get("f", k + 2), F.get("f", k + 1)))
    key = F.concat_ws(":", F.get("f", F.lit(2)), F.get("f", F.lit(0)))
    words = F.array_distinct(F.filter(names, lambda w: w != ""))
    return parsed.select(key.alias("key"), words.alias("words"), below.alias("below")).where(F.size("words") > 0)


# Builders.


def build_thesaurus(senses: DataFrame) -> DataFrame:
    """thesaurus from (key, words): the senses that have two words or more."""
    groups = senses.where(F.size("words") > 1)
    return groups.select(F.xxhash64("key").alias("group_id"), F.explode("words").alias("word"))


def build_kinds(senses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sense, edge) from (key, words, below) of nouns and verbs; edges to senses that aren't there are left out."""
    own = senses.where(F.substring("key", 1, 1).isin("n", "v"))
    sense = own.select(F.xxhash64("key").alias("sense_id"), F.explode("words").alias("name"))
    edge = own.select(F.xxhash64("key").alias("parent"), F.explode("below").alias("child"))
    edge = edge.join(own.select(F.col("key").alias("child")), "child", "left_semi")
    return sense, edge.select("parent", F.xxhash64("child").alias("child"))


def build_phonetics(pronunciations: DataFrame) -> DataFrame:
    """phonetic from (word, phones array): rhymes share all from the last stressed vowel on, homophones everything."""
    stressed = F.expr("greatest(1, coalesce(array_max(transform(phones, (p, i) -> if(p rlike '[12]$', i + 1, null))), 1))")
    tail = F.array_join(F.slice("phones", stressed, F.size("phones")), " ")
    rows = pronunciations.select("word", tail.alias("R"), F.array_join("phones", " ").alias("H"))
    keyed = rows.select("word", F.explode(F.create_map(F.lit("R"), "R", F.lit("H"), "H")).alias("kind", "key")).distinct()
    groups = keyed.groupBy("kind", "key").agg(F.count_distinct("word").alias("n")).where("n > 1")
    return keyed.join(groups, ["kind", "key"]).select("kind", F.xxhash64("key").alias("group_id"), "word")


def build_stress(pronunciations: DataFrame) -> DataFrame:
    """stress from (word, phones array): the digits of the vowels; of several pronunciations the first in order."""
    shape = F.regexp_replace(F.array_join("phones", ""), "[^0-9]", "")
    return pronunciations.groupBy("word").agg(F.min(shape).alias("shape"))


def build_neighbours(vectors: DataFrame, queries: DataFrame, k: int, antonyms: DataFrame | None = None) -> DataFrame:
    """neighbours(word, rank, neighbour) of the query words by cosine, without their antonyms.

    vectors, queries: (word, vector). queries is a stated set compared with all rows; each task keeps its k best of a
    query before the exchange (a limit within the window's partial sort).
    """
    dot = F.expr("aggregate(zip_with(a, b, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)")
    norm = lambda c: F.expr(f"sqrt(aggregate({c}, 0D, (s, x) -> s + cast(x as double) * x))")
    q = queries.select(F.col("word").alias("q"), F.col("vector").alias("a")).withColumn("na", norm("a"))
    v = vectors.select(F.col("word").alias("v"), F.col("vector").alias("b")).withColumn("nb", norm("b"))
    pairs = q.join(v, F.col("q") != F.col("v")).select("q", "v", (dot / (F.col("na") * F.col("nb"))).alias("cosine"))
    if antonyms is not None:
        pairs = pairs.join(antonyms.select(F.col("word").alias("q"), F.col("antonym").alias("v")), ["q", "v"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "v"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("word"), "rank", F.col("v").alias("neighbour"))


# Lookups, as DataFrames.


def group_members(groups: DataFrame, word: str) -> DataFrame:
    """(entry): all members of the groups that hold the word, itself too."""
    own = groups.where(F.col("word") == word).select("group_id").distinct()
    return groups.join(own, "group_id", "left_semi").select(F.col("word").alias("entry")).distinct()


def near_words(neighbours: DataFrame, word: str, n: int = NEIGHBOURS) -> DataFrame:
    """(entry, rank): the word at rank 0 and its n nearest."""
    found = neighbours.where((F.col("word") == word) & (F.col("rank") <= n)).select(F.col("neighbour").alias("entry"), "rank")
    own = neighbours.where(F.col("word") == word).select(F.col("word").alias("entry"), F.lit(0).alias("rank")).limit(1)
    return own.union(found)


def kind_names(sense: DataFrame, edge: DataFrame, word: str) -> DataFrame:
    """(entry): the names of the word's senses and of all senses below them.

    A frontier a round, without those seen before, so a sense that many paths lead to is one row and cycles end; a round's
    frontier is as long as the graph is wide, and there are as many rounds as it is deep.
    """
    empty = sense.select(F.col("sense_id").alias("id")).limit(0)
    seen, front = empty, sense.where(F.col("name") == word).select(F.col("sense_id").alias("id")).distinct().persist()
    while not front.isEmpty():
        seen = seen.union(front)
        below = front.join(edge, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        front = below.join(seen, "id", "left_anti").persist()
    return seen.join(sense, F.col("id") == F.col("sense_id")).select(F.col("name").alias("entry")).distinct()


@dataclass
class Datasets:
    """What a session has loaded; each may be missing."""

    phonetic: DataFrame | None = None
    stress: DataFrame | None = None
    thesaurus: DataFrame | None = None
    sense: DataFrame | None = None
    edge: DataFrame | None = None
    neighbours: DataFrame | None = None
    lists: DataFrame | None = None
    packs: dict = field(default_factory=dict)

    def _loaded(self, name: str, needs: str) -> DataFrame:
        found = getattr(self, needs)
        if found is None:
            raise PatternError(f"{{{name}:...}} needs the dataset {needs}, which isn't loaded")
        return found

    def entries(self, name: str, spec: str, text: str) -> list[str]:
        """The texts of a word lookup, in order; bounded by MOST_KIND or MOST_LIST."""
        word = text.lower().strip()
        if name == "list":
            return self.list(text)
        if name in ("rhyme", "homo"):
            groups = self._loaded(name, "phonetic").where(F.col("kind") == {"rhyme": "R", "homo": "H"}[name])
            df, most = group_members(groups, word), MOST_LIST
        elif name == "like":
            df, most = group_members(self._loaded(name, "thesaurus"), word), MOST_LIST
        elif name == "near":
            return [r[0] for r in near_words(self._loaded(name, "neighbours"), word, int(spec or NEIGHBOURS)).orderBy("rank").limit(MOST_LIST).collect()]
        else:
            df, most = kind_names(self._loaded(name, "sense"), self._loaded(name, "edge"), word), MOST_KIND
        found = sorted(r[0] for r in df.limit(most + 1).collect())
        if len(found) > most:
            raise PatternError(f"{{{name}:{text}}} names over {most} texts; ask for something narrower")
        return found

    def list(self, text: str) -> list[str]:
        import re

        normal = lambda t: re.sub("[^a-z0-9]+", " ", t.lower().replace("'", "")).strip()
        if "," in text:
            return [e for e in map(normal, text.split(",")) if e]
        url = text.strip().startswith(("http://", "https://"))
        key = text.strip() if url else normal(text)
        key = ALIASES.get(key.replace(" ", ""), key)
        key = key.replace(" ", "") if key.replace(" ", "") in LISTS else key
        if key in LISTS:
            return LISTS[key]
        if self.lists is not None:
            found = [r[0] for r in self.lists.where(F.col("list") == key).orderBy("pos").select("entry").limit(MOST_LIST + 1).collect()]
            if len(found) > MOST_LIST:
                raise PatternError(f'the list "{text}" has over {MOST_LIST} entries')
            if found:
                return found
        names = [*LISTS, *ALIASES] + ([r[0] for r in self.lists.select("list").distinct().limit(MOST_LIST).collect()] if self.lists is not None else [])
        near = self.suggest_list(key, names)
        raise PatternError(f'no list is named "{text}"' + (f'; did you mean "{near}"?' if near else ""))

    @staticmethod
    def suggest_list(key: str, names: list[str]) -> str | None:
        """A name that contains the key or is contained, else the most similar from 0.6 on."""
        for n in sorted(names, key=len):
            if key and (key in n or n in key):
                return n
        scored = sorted((-(1 - distance(key, n) / max(len(key), len(n), 1)), n) for n in names)
        return scored[0][1] if scored and -scored[0][0] >= 0.6 else None

    def builder(self):
        from lexigrid.plans.build import Builder

        return Builder(self.entries, self.packs)
