"""The queries of the pattern engine over the standard tables, each with the SQL that gives the same rows.

The phrase table of a folder is built once for a session and kept, the counterpart of a stored index; ``ngram_counts``
is the query that pays for building it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import datasets as D
from lexigrid.operators import predicates as P
from lexigrid.operators.search import Engine, folded, merged
from lexigrid.sources import corpus as C
from lexigrid.sources import pages as G
from lexigrid.sources.store import new_path
from lexigrid.streaming import counts as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_KEPT: dict[tuple[str, str, str], DataFrame] = {}
_STORED: dict[tuple[str, str], str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The phrase table of a table's texts, built once for a session and kept in memory or on disk."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _KEPT:
        # Only texts and scores are kept; the other columns follow from the text, each where a query asks for it.
        _KEPT[key] = C.described(C.counted(C.lines(read(spark, sf_dir, name))).persist())
    return _KEPT[key]


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the phrase table as stored: sorted by text, sorted by letters backwards, and the head."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        _STORED[key] = new_path(spark, "phrases")
        kept = (*key, "documents") in _KEPT  # else it is written as it is counted, without a copy in memory or on disk
        C.store(phrases(spark, sf_dir) if kept else C.phrase_table(read(spark, sf_dir, "documents")), _STORED[key], 20_000)
    return Engine.open(spark, _STORED[key])


def engine(spark: SparkSession, sf_dir: str, data: D.Datasets | None = None) -> Engine:
    return Engine(phrases(spark, sf_dir), data)


# SQL of the phrase table: p of n-grams up to three words, w of single words.


def _sql(table: str = "documents", words: int = 3, name: str = "p", weight: str = "count(*)") -> str:
    base = f"""{name}_l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM {table}),
{name}_s AS (SELECT unnest(string_split(regexp_replace(lower(regexp_replace(replace(line, '''', ''), '[^A-Za-z0-9]+', ' ', 'g')), '([a-z0-9]{{40}})+', chr(10), 'g'), chr(10))) AS s FROM {name}_l),
{name}_w AS (SELECT list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM {name}_s),"""
    if words == 1:
        return base + f"""
{name} AS (SELECT text, {weight} AS score FROM (SELECT unnest(w) AS text FROM {name}_w) WHERE length(text) <= 39 GROUP BY text)"""
    return base + f"""
{name}_g AS (SELECT unnest(w) AS text FROM {name}_w UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_w
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM {name}_w),
{name} AS (SELECT text, {weight} AS score FROM {name}_g WHERE length(text) <= 39 GROUP BY text)"""


P3 = "WITH " + _sql()
P1 = "WITH " + _sql(words=1)
LETTERS = "replace(text, ' ', '')"
SORTED = f"array_to_string(list_sort(string_split({LETTERS}, '')), '')"
VALUES = "list_transform(string_split({}, ''), lambda c: {})"


def full(pattern: str, column: str = "text") -> str:
    return f"regexp_full_match({column}, '{pattern}')"


def pattern(name: str, text: str, where: str, words: int = 1, score: str = "CAST(score AS DOUBLE)") -> None:
    """A search for all matches, and the condition on the phrase table that SQL can say of them."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).search(text, k=None).select("text", "score")
    ORACLES[name] = f"{P3 if words == 3 else P1}\nSELECT text, {score} AS score FROM p WHERE {where}"


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# The corpus.


@query("ngram_counts", P3 + "\nSELECT text, CAST(score AS BIGINT) AS score FROM p")
def _(spark, sf_dir):
    return C.counted(C.lines(read(spark, sf_dir, "documents")))


@query("ngram_cutoff5", P3 + "\nSELECT text, CAST(score AS BIGINT) AS score FROM p WHERE score >= 5")
def _(spark, sf_dir):
    return C.counted(C.lines(read(spark, sf_dir, "documents")), min_count=5)


@query("corpus_total", P1 + "\nSELECT CAST(sum(score) AS BIGINT) AS total FROM p")
def _(spark, sf_dir):
    return C.total(phrases(spark, sf_dir))


@query("merge_two_corpora", f"WITH {_sql(words=1, name='p')}, {_sql('conversations', 1, 'q')}\nSELECT text, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY text HAVING sum(score) >= 5")
def _(spark, sf_dir):
    tables = [C.counted(C.lines(read(spark, sf_dir, t)), 1) for t in ("documents", "conversations")]
    return C.merge(tables, 5)


@query(
    "weighted_titles",
    """WITH l AS (SELECT string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT ls[i] AS line, CASE WHEN i = 1 THEN 10 ELSE 1 END AS weight FROM (SELECT ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
s AS (SELECT unnest(string_split(regexp_replace(lower(regexp_replace(replace(line, '''', ''), '[^A-Za-z0-9]+', ' ', 'g')), '([a-z0-9]{40})+', chr(10), 'g'), chr(10))) AS s, weight FROM n),
w AS (SELECT unnest(list_filter(string_split(s, ' '), lambda x: x <> '')) AS text, weight FROM s)
SELECT text, CAST(sum(weight) AS BIGINT) AS score FROM w WHERE length(text) <= 39 GROUP BY text""",
)
def _(spark, sf_dir):
    return C.counted(C.titled_lines(read(spark, sf_dir, "documents")), 1)


@query("top_head", P3 + "\nSELECT text, CAST(score AS BIGINT) AS score FROM p ORDER BY score DESC, text LIMIT 1000")
def _(spark, sf_dir):
    return C.head(phrases(spark, sf_dir), 1000).select("text", "score")


@query("dump_index", P1 + "\nSELECT printf('%5d [%s ]', CAST(score AS BIGINT), text) AS line FROM p")
def _(spark, sf_dir):
    return C.dump(phrases(spark, sf_dir).where("n_words = 1"))


@query("probe_words", P1 + ", t AS (SELECT sum(score) AS n FROM p)\nSELECT a.text, CAST(coalesce(p.score, 0) AS BIGINT) AS score, CAST(coalesce(p.score, 0) AS DOUBLE) / CAST(t.n AS DOUBLE) AS share FROM (VALUES ('the'), ('of'), ('thble'), ('zzzz')) a(text) LEFT JOIN p ON a.text = p.text, t")
def _(spark, sf_dir):
    return engine(spark, sf_dir).probe(["the", "of", "thble", "zzzz"])


@query(
    "wordlist_build",
    f"""{P3}, u AS (SELECT text, score FROM p WHERE NOT contains(text, ' ') AND score >= 20), b AS (SELECT text, score FROM p WHERE len(string_split(text, ' ')) = 2),
f AS (SELECT split_part(text, ' ', 1) AS text, sum(score) AS s FROM b GROUP BY 1)
SELECT coalesce(u.text, f.text) AS text, CAST(greatest(coalesce(u.score, 0), coalesce(f.s, 0)) AS BIGINT) AS score FROM u FULL JOIN f ON u.text = f.text UNION ALL SELECT text, CAST(score AS BIGINT) FROM b""",
)
def _(spark, sf_dir):
    table = phrases(spark, sf_dir)
    return C.from_wordlists(table.where("n_words = 1 and score >= 20").select("text", "score"), table.where("n_words = 2").select("text", "score"))


@query("reverse_key_suffix", f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {LETTERS} LIKE '%tion' AND {full('[a-z]*', LETTERS)}")
def _(spark, sf_dir):
    return stored(spark, sf_dir).search("A*tion", k=None).select("text", "score")


@query(
    "incremental_counts",
    "WITH " + _sql("conversations") + "\nSELECT text, CAST(score AS BIGINT) AS score FROM p",
)
def _(spark, sf_dir):
    """A stream over the conversations, run to its end."""
    base = new_path(spark, "stream")
    texts = S.opened(spark, f"{sf_dir}/conversations.parquet", read(spark, sf_dir, "conversations").schema)
    S.start(texts, f"{base}/counts", f"{base}/checkpoint", once=True).awaitTermination()
    return S.current(spark, f"{base}/counts")


HTML_SQL = "html"
for _from, _to in G.HTML_STEPS:
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{_from.replace(chr(39), chr(39) * 2)}', '{_to}', 'g')".replace("'\n'", "chr(10)")


@query("remove_markup", f"SELECT page_id, trim({HTML_SQL}, ' ') AS text FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", G.html_text(F.col("html")).alias("text"))


@query(
    "list_harvest",
    f"""{P3}, h AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '{G.ENDING}', ''), '{G.ITEM}', 1)) AS raw FROM pages),
e AS (SELECT DISTINCT page_id, trim(regexp_replace(replace(lower(raw), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS entry FROM h),
c AS (SELECT entry, CAST(count(*) AS BIGINT) AS pages FROM e WHERE entry <> '' AND length(entry) <= 25 AND len(string_split(entry, ' ')) <= 3 GROUP BY entry)
SELECT entry, pages, CAST(coalesce(p.score, 0) AS BIGINT) AS score FROM c LEFT JOIN p ON c.entry = p.text""",
)
def _(spark, sf_dir):
    return G.harvested(read(spark, sf_dir, "pages"), phrases(spark, sf_dir))


# Patterns.

pattern("literal_gap", "the", f"{LETTERS} = 'the'", 3)
pattern("class_quant", "A{5}&C*", full("[b-df-hj-np-tv-z]{5}", LETTERS), 3)
pattern("char_set", "[aeiou]{4}", full("[aeiou]{4}", LETTERS), 3)
pattern("char_range", "[a-h]{4}#?", full("[a-h]{4}[0-9]?", LETTERS), 3)
pattern("negated_set", "t[^e ]*n", full("t[a-df-z0-9]*n", LETTERS), 3)
pattern("quoted_phrase", '"of the A{2}"', full("of the [a-z]{2}"), 3)
pattern("optional_space", '"t-he"', "text IN ('the', 't he')", 3)
pattern("alternation", "of|the|(and A)", f"{LETTERS} IN ('of', 'the') OR {full('a *n *d +[a-z]')}", 3)
pattern("intersection", "A{6}&.*th.*", f"{full('[a-z]{6}', LETTERS)} AND contains({LETTERS}, 'th')", 3)
pattern("negation", "A{4}&!.*a.*", f"{full('[a-z]{4}', LETTERS)} AND NOT contains(text, 'a')", 3)
pattern("deep_negation", "A{5}&!.*ee.*&!.*th.*", f"{full('[a-z]{5}', LETTERS)} AND NOT contains({LETTERS}, 'ee') AND NOT contains({LETTERS}, 'th')", 3)
pattern("three_word", '"A{3} A{3} A{3}"', full("[a-z]{3} [a-z]{3} [a-z]{3}"), 3)
pattern("suffix_anchor", ".*tion", f"{LETTERS} LIKE '%tion'", 3)
pattern("prefix_anchor", "thing.*", f"{LETTERS} LIKE 'thing%'", 3)
pattern("group_quantifier", '"(th|an){2,3}"', full("(th|an){2,3}"))
pattern("nested_negation", '"th(!.*e.*)"', "text LIKE 'th%' AND NOT contains(substr(text, 3), 'e')", 3)
pattern("nested_intersection", '"(A{3}&.*h.*)ing"', f"{full('[a-z]{3}ing')} AND contains(substr(text, 1, 3), 'h')")
pattern("letter_anagram", "<aeht>", f"{SORTED} = 'aeht'", 3)
pattern(
    "anagram_parts", '"<A{2}th>"',
    f"{full('([a-z]{2}|t|h){3}')} AND {full('[th]*[a-z]{2}[th]*')} AND {full('([a-z]{2}|h)*t([a-z]{2}|h)*')} AND {full('([a-z]{2}|t)*h([a-z]{2}|t)*')}",
)
pattern("letter_bank", "<<then>>", f"{full('[then]*', LETTERS)} AND contains(text, 't') AND contains(text, 'h') AND contains(text, 'e') AND contains(text, 'n')", 3)
pattern("capture", '"{=a:A{3}}ing"', full("[a-z]{3}ing"))

# Counting, bags, shapes.

SUM = f"list_sum({VALUES.format('text', 'ascii(c) - 96')})"
SCRABBLE = "list_sum(" + VALUES.format("text", "[1,3,3,2,1,4,2,4,1,8,5,1,3,1,1,3,10,1,1,1,1,4,4,8,4,10][ascii(c) - 96]") + ")"
WORD = full("[a-z]+")
pattern("sum_eq", '{sum=52:"A*"}', f"{WORD} AND {SUM} = 52")
pattern("sum_range", '{sum=50..60:"A{5}"}', f"{full('[a-z]{5}')} AND {SUM} BETWEEN 50 AND 60")
pattern("scrabble_gt", '{scrabble>20:"A*"}', f"{WORD} AND {SCRABBLE} > 20")
pattern("count_vowels", '{count(vowel)>=5:"A*"}', f"{WORD} AND length(regexp_replace(text, '[^aeiou]', '', 'g')) >= 5")
pattern("letters_eq", '{letters=7:"_*"}', "length(regexp_replace(text, '[^a-z]', '', 'g')) = 7")
pattern("words_eq", "{words=3:A*}", f"{full('[a-z]+ [a-z]+ [a-z]+')}", 3)
pattern("all_letters", '{all(aeo):"A*"}', f"{WORD} AND contains(text, 'a') AND contains(text, 'e') AND contains(text, 'o')")
pattern("distinct_letters", '{distinct:"A{6}"}', f"{full('[a-z]{6}')} AND len(list_distinct(string_split(text, ''))) = 6")
MAXREP = " AND ".join(f"length(text) - length(replace(text, '{c}', '')) <= 2" for c in "abcdefghijklmnopqrstuvwxyz")
pattern("maxrep", '{maxrep=2:"A{8}"}', f"{full('[a-z]{8}')} AND {MAXREP}")
SUB = " AND ".join(f"length(text) - length(replace(text, '{c}', '')) <= {n}" for c, n in {"t": 1, "h": 1, "e": 2, "r": 1, "a": 1, "n": 2, "d": 1, "o": 1}.items())
pattern("sub_letters", '{sub:thereandon}&"A*"', f"{full('[therando]+')} AND {SUB}")
pattern("bank_letters", '{bank:then}&"A*"', f"{full('[then]+')} AND contains(text, 't') AND contains(text, 'h') AND contains(text, 'e') AND contains(text, 'n')")
for _name, _set in {"roman": "ivxlcdm", "rot180": "hinosxz", "mirror": "ahimotuvwxy", "sevenseg": "abcdefghijlnopqrstuy", "row1": "qwertyuiop", "row2": "asdfghjkl", "row3": "zxcvbnm"}.items():
    pattern(_name, f'{{{_name}:"A{{2,}}"}}', full(f"[{_set}]{{2,}}"))
pattern("holes_0", '{holes=0:"A{3,}"}', full("[cefghijklmnstuvwxyz]{3,}"))
pattern("holes_1", '{holes=1:"_{2,}"}', full("[adopqr0469]{2,}"))
pattern("ascending", '{ascending:"A{3,}"}', f"{full('[a-z]{3,}')} AND text = {SORTED}")
pattern("descending", '{descending:"A{3,}"}', f"{full('[a-z]{3,}')} AND text = reverse({SORTED})")

# Ciphers and spelling codes.

pattern("caesar", "{caesar:wkh}", "text IN (SELECT array_to_string(list_transform(['w','k','h'], lambda c: chr(CAST(97 + (ascii(c) - 97 + n) % 26 AS INTEGER))), '') FROM range(1, 26) t(n))", 3)
pattern("rot", "{rot7:max}", "text = 'the'", 3)
pattern("rot13", "{rot13:bs}", "text = 'of'", 3)
pattern("atbash", "{atbash:gsv}", "text = 'the'", 3)
pattern("vigenere", "{vigenere(key):dlc}", "text = 'the'", 3)
pattern("playfair", "{playfair(monarchy):hp}", "text = 'of'", 3)
pattern("t9", "{t9:843}", full("[tuv][ghi][def]"))
pattern("enum", "{enum:3,2,3}", full("[a-z]{3} [a-z]{2} [a-z]{3}"), 3)
MORSE_LIST = "['.-','-...','-.-.','-..','.','..-.','--.','....','..','.---','-.-','.-..','--','-.','---','.--.','--.-','.-.','...','-','..-','...-','.--','-..-','-.--','--..','-----','.----','..---','...--','....-','.....','-....','--...','---..','----.']"
pattern("morse", "{morse:-....}", f"array_to_string({VALUES.format('text', MORSE_LIST + '[instr(' + chr(39) + 'abcdefghijklmnopqrstuvwxyz0123456789' + chr(39) + ', c)]')}, '') = '-....'")
ELEMENTS = "h|he|li|be|b|c|n|o|f|ne|na|mg|al|si|p|s|cl|ar|k|ca|sc|ti|v|cr|mn|fe|co|ni|cu|zn|ga|ge|as|se|br|kr|rb|sr|y|zr|nb|mo|tc|ru|rh|pd|ag|cd|in|sn|sb|te|i|xe|cs|ba|la|ce|pr|nd|pm|sm|eu|gd|tb|dy|ho|er|tm|yb|lu|hf|ta|w|re|os|ir|pt|au|hg|tl|pb|bi|po|at|rn|fr|ra|ac|th|pa|u|np|pu|am|cm|bk|cf|es|fm|md|no|lr|rf|db|sg|bh|hs|mt|ds|rg|cn|nh|fl|mc|lv|ts|og"
pattern("elements", '{elements:"A{6}"}', f"{full('[a-z]{6}')} AND {full('(' + ELEMENTS + ')*')}")
pattern("a1z26", "{a1z26:1914}", "text IN ('aiad', 'sad', 'ain', 'sn')", 3)
pattern("braille", "{braille:1 1345 145}", "text = 'and'", 3)
pattern("bacon", "{bacon:baabb aabbb aabaa}", "text IN ('the', 'uhe', 'vhe')", 3)
pattern("bin5", "{bin5:01111 00110}", "text = 'of'", 3)
pattern("semaphore", "{semaphore:nw-sw sw-se}", "text = 'in'", 3)
pattern("ascii", "{ascii:105 0x6e}", "text = 'in'", 3)
pattern("polybius", "{polybius:34 21}", "text = 'of'", 3)

# Edits.

EDGE = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1))"
pattern("del1", "{del1:there}", f"list_contains({EDGE.format(chr(39) + 'there' + chr(39))}, text)")
pattern("add1", "{add1:the}", f"length(text) = 4 AND list_contains({EDGE.format('text')}, 'the')")
pattern("subst1", "{subst1:the}", "length(text) = 3 AND hamming(CASE WHEN length(text) = 3 THEN text ELSE '   ' END, 'the') = 1")
pattern("edit_le2", "{edit<=2:there}", "levenshtein(text, 'there') <= 2")
pattern("edit_letters", "{del1(h):there}", "text = 'tere'")
pattern("edit_list", "{del1:{list:there,thing}}", f"list_contains({EDGE.format(chr(39) + 'there' + chr(39))}, text) OR list_contains({EDGE.format(chr(39) + 'thing' + chr(39))}, text)")
pattern("edit_graded", "{edit:there}", "levenshtein(text, 'there') <= 3", score="CAST(score AS DOUBLE) * CASE levenshtein(text, 'there') WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1e-12::DOUBLE WHEN 2 THEN 1e-24::DOUBLE ELSE 1e-36::DOUBLE END")

# Predicates.


def noted(name: str, text: str, sql: str, data: Callable[[SparkSession, str], D.Datasets] | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, data and data(spark, sf_dir)).search(text, k=None).select("text", "score", "note")
    ORACLES[name] = sql


def _stress(spark: SparkSession, sf_dir: str) -> D.Datasets:
    rows = [("the", "0"), ("of", "0"), ("and", "1"), ("that", "1"), ("thing", "1"), ("ertion", "10"), ("from", "1"), ("are", "2")]
    return D.Datasets(stress=spark.createDataFrame(rows, "word string, shape string"))


STRESS_SQL = f"""{P3}, d(word, shape) AS (VALUES ('the', '0'), ('of', '0'), ('and', '1'), ('that', '1'), ('thing', '1'), ('ertion', '10'), ('from', '1'), ('are', '2')),
x AS (SELECT text, score, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM p),
y AS (SELECT text, score, string_agg(shape, '' ORDER BY i) AS shape FROM x LEFT JOIN d USING (word) GROUP BY text, score HAVING count(shape) = count(*))"""
pattern("palindrome", '{palindrome:"A{4,}"}', f"{full('[a-z]{4,}')} AND text = reverse(text)")
pattern("palindrome_phrase", "{palindrome:A{5,}}", f"{full('[a-z]{5,}', LETTERS)} AND {LETTERS} = reverse({LETTERS})", 3)
noted("reversible", '{reversible:"A{4}"}', f"{P1}, n AS (SELECT sum(score) AS n FROM p)\nSELECT a.text, CAST(a.score AS DOUBLE) AS score, '← ' || b.text AS note FROM p a JOIN p b ON reverse(a.text) = b.text, n WHERE {full('[a-z]{4}', 'a.text')} AND a.text <> b.text AND b.score >= n.n * 0.000001::DOUBLE")
KNOWN = "n AS (SELECT sum(score) AS n FROM p), k AS (SELECT text FROM p, n WHERE length(text) >= 2 AND score >= n.n * 0.00001::DOUBLE)"
noted(
    "compound_2", '{compound 2:"A{7}"}',
    f"""{P1}, {KNOWN}, c AS (SELECT text, score, i, substr(text, 1, i) AS a, substr(text, i + 1) AS b FROM p, range(2, 6) t(i) WHERE {full('[a-z]{7}')}),
r AS (SELECT text, score, a || '·' || b AS note, row_number() OVER (PARTITION BY text ORDER BY least(i, 7 - i) DESC, i) AS r FROM c WHERE a IN (SELECT text FROM k) AND b IN (SELECT text FROM k))
SELECT text, CAST(score AS DOUBLE) AS score, note FROM r WHERE r = 1""",
)
pattern("compound_3", '{compound 3:"A{8}"}', f"{full('[a-z]{8}')} AND EXISTS (SELECT 1)")
ORACLES["compound_3"] = f"""{P1}, {KNOWN}, c AS (SELECT DISTINCT text, score FROM p, range(2, 5) t(i), range(4, 7) u(j) WHERE {full('[a-z]{8}')} AND j - i >= 2
  AND substr(text, 1, i) IN (SELECT text FROM k) AND substr(text, i + 1, j - i) IN (SELECT text FROM k) AND substr(text, j + 1) IN (SELECT text FROM k))
SELECT text, CAST(score AS DOUBLE) AS score FROM c"""
noted("syllables", "{syllables>=2:A*}", f"{STRESS_SQL}\nSELECT text, CAST(score AS DOUBLE) AS score, length(shape) || ' syll' AS note FROM y WHERE length(shape) >= 2", _stress)
noted("stress", "{stress 010:A*}", f"{STRESS_SQL}\nSELECT text, CAST(score AS DOUBLE) AS score, '' AS note FROM y WHERE replace(shape, '2', '1') = '010'", _stress)
noted("anagram_list", '{anagram {list:hte,heat,dna}:"A*"}', f"{P1}, e(pos, entry) AS (VALUES (0, 'dna'), (1, 'heat'), (2, 'hte'))\nSELECT text, CAST(score AS DOUBLE) AS score, '← ' || entry AS note FROM p JOIN e ON {SORTED} = array_to_string(list_sort(string_split(entry, '')), '') AND text <> entry")
noted("iso", "{iso:xyyx}", f"{P1}\nSELECT text, CAST(score AS DOUBLE) AS score, 'x=' || substr(text, 1, 1) || ' y=' || substr(text, 2, 1) AS note FROM p WHERE {full('[a-z]{4}')} AND substr(text, 1, 1) = substr(text, 4, 1) AND substr(text, 2, 1) = substr(text, 3, 1) AND substr(text, 1, 1) <> substr(text, 2, 1)")
PAIR = f"{full('[a-z]{2,4} [a-z]{2,4}')}"
A, B = "split_part(text, ' ', 1)", "split_part(text, ' ', 2)"
pattern("rev_pair", '{rev a,b:"{=a:A{2,4}} {=b:A{2,4}}"}', f"{PAIR} AND {A} = reverse({B})", 3)
pattern("eq_pair", '{eq a,b:"{=a:A{2,4}} {=b:A{2,4}}"}', f"{PAIR} AND {A} = {B}", 3)
pattern("shift13_pair", '{shift13 a,b:"{=a:A{2,4}} {=b:A{2,4}}"}', f"{PAIR} AND length({A}) = length({B}) AND {B} = translate({A}, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm')", 3)
SHIFT = "(ascii(substr({1}, {0}, 1)) - ascii(substr({2}, {0}, 1)) + 26) % 26"
S1, S2 = SHIFT.format(1, B, A), SHIFT.format(2, B, A)
noted("shift_pair", '{shift a,b:"{=a:A{2}} {=b:A{2}}"}', f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score, 'shift +' || {S1} AS note FROM p WHERE {full('[a-z]{2} [a-z]{2}')} AND {S1} = {S2} AND {S1} <> 0")
pattern("nested_palindrome", '"{palindrome:A{3}} A{2}"', f"{full('[a-z]{3} [a-z]{2}')} AND substr(text, 1, 1) = substr(text, 3, 1)", 3)
pattern("not_palindrome", '!{palindrome:A*}&"A{3}"', f"{full('[a-z]{3}')} AND text <> reverse(text)")

# Lookups.

pattern("list_inline", "{list:the,of the,and}", "text IN ('the', 'of the', 'and')", 3)
pattern("soft_list", '{~list:the,of}&"A{2,3}"', full("[a-z]{2,3}"), score="CAST(score AS DOUBLE) * CASE WHEN text IN ('the', 'of') THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END")


def _benchmark_lists(spark: SparkSession, sf_dir: str) -> D.Datasets:
    """A harvested list: the first two words of each benchmark item."""
    from lexigrid.functions.text import entry

    first = read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("list"), F.col("item_id").cast("int").alias("pos"), F.array_join(F.slice(F.split(entry(F.col("text")), " "), 1, 2), " ").alias("entry"))
    return D.Datasets(lists=first)


@query("list_table", f"{P3}, e AS (SELECT DISTINCT array_to_string(list_slice(string_split(trim(regexp_replace(replace(lower(text), '''', ''), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 2), ' ') AS entry FROM benchmark)\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE text IN (SELECT entry FROM e)")
def _(spark, sf_dir):
    return engine(spark, sf_dir, _benchmark_lists(spark, sf_dir)).search("{list:benchmark}", k=None).select("text", "score")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions over nations over suppliers, as senses and edges."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    sense = region.select(F.col("r_regionkey").cast("int").alias("sense_id"), F.lower("r_name").alias("name"))
    sense = sense.union(nation.select((F.col("n_nationkey") + 1000).cast("int"), F.lower("n_name")))
    sense = sense.union(supplier.select((F.col("s_suppkey") + 100000).cast("int"), F.lower("s_name")))
    edge = nation.select(F.col("n_regionkey").cast("int").alias("parent"), (F.col("n_nationkey") + 1000).cast("int").alias("child"))
    return sense, edge.union(supplier.select((F.col("s_nationkey") + 1000).cast("int"), (F.col("s_suppkey") + 100000).cast("int")))


@query(
    "kind_closure",
    """WITH RECURSIVE sense AS (SELECT r_regionkey AS id, lower(r_name) AS name FROM region UNION ALL SELECT n_nationkey + 1000, lower(n_name) FROM nation UNION ALL SELECT s_suppkey + 100000, lower(s_name) FROM supplier),
edge AS (SELECT n_regionkey AS parent, n_nationkey + 1000 AS child FROM nation UNION ALL SELECT s_nationkey + 1000, s_suppkey + 100000 FROM supplier),
below AS (SELECT id FROM sense WHERE name = 'asia' UNION SELECT e.child FROM below b JOIN edge e ON e.parent = b.id)
SELECT DISTINCT s.name AS entry FROM below b JOIN sense s ON s.id = b.id""",
)
def _(spark, sf_dir):
    return D.kind_names(*_graph(spark, sf_dir), "asia")


def _senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations, as a dictionary's lines written and read."""
    joined = lambda c: F.translate(c, " ", "_")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey") + 1000, "n_name", "n_regionkey").toDF("n", "name", "r")
    below = nation.groupBy("r").agg(F.array_sort(F.collect_list(F.format_string("~ %08d n 0000", "n"))).alias("b"))  # nations are few
    region = read(spark, sf_dir, "region").join(below, F.col("r") == F.col("r_regionkey"))
    top = region.select(F.format_string("%08d 15 n 02 %s 0 %s_region 0 %03d %s | a region", "r_regionkey", joined("r_name"), joined("r_name"), F.size("b"), F.array_join("b", " ")).alias("value"))
    leaf = nation.select(F.format_string("%08d 15 n 01 %s 0 000 | a nation", "n", joined("name")).alias("value"))
    path = new_path(spark, "dict")
    top.union(leaf).coalesce(1).write.text(path)
    return D.read_senses(spark, path, "part-*")


@query("thesaurus_build", "SELECT unnest([lower(r_name), lower(r_name) || ' region']) AS word FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def _(spark, sf_dir):
    return D.build_thesaurus(_senses(spark, sf_dir)).select("word")


@query("kind_build", "SELECT unnest(['asia', 'asia region']) AS entry UNION ALL SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _(spark, sf_dir):
    return D.kind_names(*D.build_kinds(_senses(spark, sf_dir)), "asia")


@query("group_lookup", "SELECT DISTINCT p_name AS entry FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_name = 'small ring')")
def _(spark, sf_dir):
    groups = read(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("word"))
    return D.group_members(groups, "small ring")


@query(
    "neighbours_build",
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT q.vec_id AS word, v.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT word, CAST(rank AS INTEGER) AS rank, neighbour FROM r WHERE rank <= 5""",
)
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    return D.build_neighbours(vectors, vectors.where("word % 20 = 0"), 5)


_SOUNDS = [("night", "N AY1 T"), ("knight", "N AY1 T"), ("light", "L AY1 T"), ("alight", "AH0 L AY1 T"), ("the", "DH AH0"), ("a", "AH0"), ("of", "AH1 V"), ("love", "L AH1 V"), ("thing", "TH IH1 NG"), ("sing", "S IH1 NG")]


def _phonetic(spark: SparkSession, sf_dir: str) -> D.Datasets:
    words = spark.createDataFrame(_SOUNDS, "word string, p string").select("word", F.split("p", " ").alias("phones"))
    rows = [(1, "the"), (1, "of"), (1, "that"), (2, "thing"), (2, "tion"), (2, "the")]
    thesaurus = spark.createDataFrame(rows, "group_id int, word string")
    near = spark.createDataFrame([("the", 1, "of"), ("the", 2, "and"), ("the", 3, "that"), ("of", 1, "the")], "word string, rank int, neighbour string")
    sense = spark.createDataFrame([(0, "word"), (1, "the"), (2, "of"), (3, "and")], "sense_id int, name string")
    edge = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "parent int, child int")
    return D.Datasets(D.build_phonetics(words), D.build_stress(words), thesaurus, sense, edge, near)


def lookup(name: str, text: str, found: tuple[str, ...]) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, _phonetic(spark, sf_dir)).search(text, k=None).select("text", "score")
    ORACLES[name] = f"{P1}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE text IN ({', '.join(repr(f) for f in found)})"


lookup("rhyme", "{rhyme:thing}", ("thing", "sing"))
lookup("homo", "{homo:night}", ("night", "knight"))
lookup("like", "{like:the}", ("the", "of", "that", "thing", "tion"))
lookup("near", "{near 2:the}", ("the", "of", "and"))
lookup("kind", "{kind:word}", ("word", "the", "of", "and"))


@query("near_soft", f"{P1}\nSELECT text, CAST(score AS DOUBLE) * CASE text WHEN 'the' THEN 1.0::DOUBLE WHEN 'of' THEN 0.9::DOUBLE WHEN 'and' THEN CAST(0.9 * 0.9 AS DOUBLE) ELSE 0.01::DOUBLE END AS score FROM p WHERE {full('[a-z]{2,3}')}")
def _(spark, sf_dir):
    df = engine(spark, sf_dir, _phonetic(spark, sf_dir)).search('{~near 2:the}&"A{2,3}"', k=None)
    return df.select("text", "score")


@query("near_order", f"{P1}\nSELECT text, CAST(score AS DOUBLE) AS score, CASE text WHEN 'the' THEN 0 WHEN 'of' THEN 1 WHEN 'and' THEN 2 END AS near_rank FROM p WHERE {full('[a-z]{2,3}')}")
def _(spark, sf_dir):
    e = engine(spark, sf_dir, _phonetic(spark, sf_dir))
    return P.near_order(e.matches('"A{2,3}"'), D.near_words(e.data.neighbours, "the", 2)).select("text", "score", "near_rank")


# Search.


@query(
    "restart_two_segment",
    f"""{P3}, n AS (SELECT CAST(sum(score) AS DOUBLE) AS n FROM p WHERE NOT contains(text, ' ')), a AS (SELECT * FROM p WHERE regexp_matches(text, '^of( the( [a-z]{{2}})?)?$')), b AS (SELECT * FROM p WHERE regexp_matches(text, '[a-z]{{3}} of$')),
s AS (SELECT text, CAST(score AS DOUBLE) AS score, 1 AS segments FROM p WHERE {full('of the [a-z]{2} [a-z]{3} of')}
  UNION ALL SELECT a.text || ' ' || b.text, CAST(a.score AS DOUBLE) * (0.000001::DOUBLE / n.n) * CAST(b.score AS DOUBLE), 2 FROM a, b, n WHERE {full('of the [a-z]{2} [a-z]{3} of', "a.text || ' ' || b.text")})
SELECT text, max(score) AS score FROM s GROUP BY text""",
)
def _(spark, sf_dir):
    return engine(spark, sf_dir).search('"of the A{2} A{3} of"', k=None, segments=2).select("text", "score")


@query(
    "merged_corpora",
    f"""WITH {_sql(words=1)}, {_sql('conversations', 1, 'q')}, m AS (SELECT greatest((SELECT sum(score) FROM p), (SELECT sum(score) FROM q)) AS m),
u AS (SELECT text, CAST(score AS DOUBLE) * (CAST(m AS DOUBLE) / (SELECT CAST(sum(score) AS DOUBLE) FROM p)) AS score, 'documents' AS source FROM p, m UNION ALL SELECT text, CAST(score AS DOUBLE) * (CAST(m AS DOUBLE) / (SELECT CAST(sum(score) AS DOUBLE) FROM q)), 'conversations' FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, source) AS r FROM u WHERE {full('[a-z]{3}')})
SELECT text, score, source FROM r WHERE r = 1""",
)
def _(spark, sf_dir):
    return merged({t: Engine(phrases(spark, sf_dir, t)) for t in ("documents", "conversations")}, '"A{3}"', k=None)


@query("score_floor", f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {full('[a-z]{5}', LETTERS)} AND score >= 0.01::DOUBLE * (SELECT max(score) FROM p WHERE {full('[a-z]{5}', LETTERS)})")
def _(spark, sf_dir):
    return engine(spark, sf_dir).search("A{5}", k=None, floor=0.01).select("text", "score")


@query("page_two", f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {full('[a-z]{4}', LETTERS)} ORDER BY score DESC, text LIMIT 20 OFFSET 20")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    last = e.search("A{4}", k=20).tail(1)[0]
    return e.search("A{4}", k=20, after=(last["score"], last["text"])).select("text", "score")


pattern("finite_probe", '"(th|an|of)(e|at|d)?"', full("(th|an|of)(e|at|d)?"))


@query("fold_variants", f"{P3}, r AS (SELECT text, score, row_number() OVER (PARTITION BY {LETTERS} ORDER BY score DESC, text) AS r FROM p WHERE {full('[a-z]{5}', LETTERS)})\nSELECT text, CAST(score AS DOUBLE) AS score FROM r WHERE r = 1")
def _(spark, sf_dir):
    return folded(engine(spark, sf_dir).search("A{5}", k=None)).select("text", "score")


@query("shards", f"{P3}\nSELECT substr(text, 1, 1) AS shard, CAST(count(*) AS BIGINT) AS n, CAST(sum(score) AS BIGINT) AS score FROM p GROUP BY 1")
def _(spark, sf_dir):
    return phrases(spark, sf_dir).groupBy(F.substring("text", 1, 1).alias("shard")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("suffix_debris", f"{P1}, s AS (SELECT right(text, n) AS suffix, score FROM p, range(2, 7) t(n) WHERE length(text) >= n)\nSELECT suffix, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY suffix")
def _(spark, sf_dir):
    return P.suffix_counts(phrases(spark, sf_dir))


@query("pack_constructs", f"{P1}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {full('[aeiouth]{4}')}")
def _(spark, sf_dir):
    from lexigrid.plans import packs

    data = D.Datasets(packs=packs.load({"name": "demo", "constructs": [{"name": "soft", "type": "letter-class", "summary": "vowels, t and h", "letters": "aeiouth"}]}))
    return engine(spark, sf_dir, data).search('{soft:"A{4}"}', k=None).select("text", "score")


# Stored tables, plans kept, pages.


@query("stats", P3 + "\nSELECT CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, CAST(count(*) AS BIGINT) AS phrases, CAST(sum(score) AS BIGINT) AS occurrences, CAST(max(score) AS BIGINT) AS most, CAST(max(length(text)) AS INTEGER) AS longest FROM p GROUP BY 1")
def _(spark, sf_dir):
    return C.stats(phrases(spark, sf_dir))


@query("stored_table", P3 + "\nSELECT text, CAST(score AS BIGINT) AS score FROM p")
def _(spark, sf_dir):
    return stored(spark, sf_dir).table.select("text", "score")


@query("first_page", f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {full('[a-z]{4}', LETTERS)} ORDER BY score DESC, text LIMIT 20")
def _(spark, sf_dir):
    return stored(spark, sf_dir).first_page("A{4}", 20).select("text", "score")


@query("refined_search", f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE {full('[a-z]{5}', LETTERS)} AND contains({LETTERS}, 'th')")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.keep("A{5}")
    return e.search("A{5}&.*th.*", k=None).select("text", "score")


@query("five_words", "WITH " + _sql(words=3).split("p_g AS")[0].rstrip().rstrip(",") + """, g AS (SELECT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS text FROM p_w)
SELECT text, CAST(count(*) AS DOUBLE) AS score FROM g WHERE regexp_full_match(text, '[a-z]{2,4} [a-z]{2,4} [a-z]{2,4} [a-z]{2,4} [a-z]{2,4}') AND length(text) <= 39 GROUP BY text""")
def _(spark, sf_dir):
    """Phrases as long as the pattern needs: a table counted with five words."""
    table = C.phrase_table(read(spark, sf_dir, "documents"), max_words=5).where("n_words = 5")
    return Engine(table).search('"A{2,4} A{2,4} A{2,4} A{2,4} A{2,4}"', k=None).select("text", "score")


# Lists and sets that patterns name.

pattern("list_builtin", "{list:solfa}", "text IN ('do', 're', 'mi', 'fa', 'sol', 'la', 'ti')", 3)
noted("anagram_pattern", '{anagram (th|ha)[ent]:"A{3}"}', f"{P1}, e(entry) AS (VALUES ('the'), ('thn'), ('tht'), ('hae'), ('han'), ('hat'))\nSELECT text, CAST(score AS DOUBLE) AS score, '← ' || entry AS note FROM p JOIN e ON {SORTED} = array_to_string(list_sort(string_split(entry, '')), '') AND text <> entry")


@query("list_url", P1 + "\nSELECT text, CAST(score AS DOUBLE) AS score FROM p WHERE text IN ('the', 'of', 'and')")
def _(spark, sf_dir):
    url, path = "https://lists.example/short.txt", new_path(spark, "list")
    spark.createDataFrame([("# short words\nThe\nof # twice\n\nAND",)], "value string").coalesce(1).write.text(path)
    return engine(spark, sf_dir, D.Datasets(lists=D.remote_list(spark, path, url))).search(f"{{list:{url}}}", k=None).select("text", "score")


WIKI_SQL = "'== ' || lang || ' ==' || chr(10) || '* [[' || source || '|the ' || lang || ']] {{cite}} ' || left(text, 40) || '<ref>x</ref>'"
for _from, _to in G.WIKI_STEPS:
    WIKI_SQL = f"regexp_replace({WIKI_SQL}, '{_from.replace(chr(39), chr(39) * 2)}', '{_to.replace('$1', chr(92) + '1')}', 'g')"


@query("wiki_markup", f"SELECT doc_id, trim({WIKI_SQL}, ' ') AS text FROM documents")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    markup = F.concat(F.lit("== "), "lang", F.lit(" ==\n* [["), "source", F.lit("|the "), "lang", F.lit("]] {{cite}} '''"), F.substring("text", 1, 40), F.lit("'''<ref>x</ref>"))
    return docs.select("doc_id", G.wiki_text(markup).alias("text"))


# Automata over columns: the algebra, on words of up to five letters.


def algebra(name: str, make: Callable, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lexigrid.functions.dfa import accepts
        from lexigrid.plans.syntax import parse

        build = D.Datasets().builder()
        dfa = make(lambda text: build.dfa(parse(f'"{text}"')))
        return phrases(spark, sf_dir).where("n_words = 1 and n_letters <= 5").where(accepts(dfa, F.col("text"))).select("text", "score")

    QUERIES[name] = run
    ORACLES[name] = f"{P1}\nSELECT text, CAST(score AS BIGINT) AS score FROM p WHERE length(text) <= 5 AND {condition}"


def _nfa(join: str) -> Callable:
    from lexigrid.plans.automata import Dfa, Nfa

    return lambda dfa: Dfa.of(getattr(Nfa, join)([dfa("th").nfa(), dfa("A{2}").nfa()]))


def _star(dfa):
    from lexigrid.plans.automata import Dfa, Nfa

    return Dfa.of(Nfa.repeat(dfa("(th|an|e)").nfa(), 0, None))


def _reversed(dfa):
    from lexigrid.plans.automata import Dfa

    return Dfa.of(dfa("th[ae]A*").nfa().reversed())


algebra("automata_union", _nfa("union"), full("th|[a-z]{2}"))
algebra("automata_concat", _nfa("concat"), full("th[a-z]{2}"))
algebra("automata_star", _star, full("(th|an|e)*"))
algebra("automata_reverse", _reversed, full("[a-z]*[ae]ht"))
algebra("automata_product", lambda dfa: dfa("A{4}").product(dfa(".*th.*")), f"{full('[a-z]{4}')} AND contains(text, 'th')")
algebra("automata_complement", lambda dfa: dfa("A{4}").product(dfa(".*e.*").complement()), f"{full('[a-z]{4}')} AND NOT contains(text, 'e')")
algebra("automata_minimal", lambda dfa: dfa("(tha|the|aha|ahe)").trimmed(), full("[ta]h[ae]"))


# What the driver says of patterns and matches.


def said(name: str, rows: Callable[[], list[tuple]], schema: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(rows(), schema)
    ORACLES[name] = sql


def _driver() -> tuple:
    from lexigrid.plans import explain
    from lexigrid.plans.automata import Dfa
    from lexigrid.plans.syntax import PatternError, parse

    def error(text: str) -> str:
        try:
            return str(D.Datasets().builder().dfa(parse(text))) and ""
        except PatternError as e:
            return str(e)

    return explain, Dfa, parse, error


said("completion", lambda: [(c,) for c in _driver()[0].complete("{list:mo")], "name string", "SELECT * FROM (VALUES ('mohs'), ('monopoly'), ('months'), ('moons')) t(name)")
said("list_suggestion", lambda: [(q, D.Datasets.suggest_list(q, ["planets", "months", "greek"])) for q in ("planet", "mnths", "greek letters", "qqq")], "asked string, near string", "SELECT * FROM (VALUES ('planet', 'planets'), ('mnths', 'months'), ('greek letters', 'greek'), ('qqq', NULL)) t(asked, near)")
said("diagnostics", lambda: [(p, "palindrome" in _driver()[3](p)) for p in ("{palindrone:A*}", "{palindrome:A{3}}&A{3}", "{qqqqqq:A}")], "pattern string, suggests boolean", "SELECT * FROM (VALUES ('{palindrone:A*}', true), ('{palindrome:A{3}}&A{3}', false), ('{qqqqqq:A}', false)) t(pattern, suggests)")
said("conflict", lambda: [(p, _driver()[0].plan(p)["empty"]) for p in ("A{3}&A{4}", "A{3}&.*th.*", "th&!th", "{sum=3:A{4}}")], "pattern string, empty boolean", "SELECT * FROM (VALUES ('A{3}&A{4}', true), ('A{3}&.*th.*', false), ('th&!th', true), ('{sum=3:A{4}}', true)) t(pattern, empty)")
said("plan", lambda: [(p, x["conjuncts"], x["verifies"], ",".join(x["missing"])) for p in ("A{5}&C*", "{palindrome:A{5}}", "{rhyme:night}&A{5}") for x in [_driver()[0].plan(p)]], "pattern string, conjuncts int, verifies boolean, missing string", "SELECT * FROM (VALUES ('A{5}&C*', 2, false, ''), ('{palindrome:A{5}}', 1, true, ''), ('{rhyme:night}&A{5}', 2, false, 'phonetic')) t(pattern, conjuncts, verifies, missing)")
said("score_format", lambda: [(x, _driver()[0].shown_score(x)) for x in (5.0, 1234567.0, 0.25)], "score double, shown string", "SELECT CAST(score AS DOUBLE) AS score, shown FROM (VALUES (5.0, '5'), (1234567.0, '1234567'), (0.25, '0.25')) t(score, shown)")


def paged(name: str, text: str, column: str, say: Callable[[str, str], str], sql: str) -> None:
    """The first page of a search, each row with a sentence: as many rows as a page has go through the driver."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = engine(spark, sf_dir).search(text, k=50).select("text", "score").collect()
        return spark.createDataFrame([(r["text"], r["score"], say(text, r["text"])) for r in page], f"text string, score double, {column} string")

    QUERIES[name], ORACLES[name] = run, sql


paged("match_explanation", '{sum=52:"A*"}', "why", lambda p, t: "; ".join(s for _, s in _driver()[0].reasons(p, t)), f"{P1}\nSELECT text, CAST(score AS DOUBLE) AS score, 'its values make ' || CAST({SUM} AS INTEGER) AS why FROM p WHERE {WORD} AND {SUM} = 52 ORDER BY score DESC, text LIMIT 50")
paged("derived_notes", "{caesar:wkh}", "note", lambda p, t: _driver()[0].derived_note(p, t), f"{P3}\nSELECT text, CAST(score AS DOUBLE) AS score, 'shift +' || CAST((ascii(text) - 119 + 26) % 26 AS INTEGER) AS note FROM p WHERE {ORACLES['caesar'].split(' WHERE ', 1)[1].rpartition('WHERE ')[2]} ORDER BY score DESC, text LIMIT 50")


@query("manifest", "SELECT 'A demo' AS description, 'de' AS language, true AS transliterate, 'strasse' AS pattern")
def _(spark, sf_dir):
    from lexigrid.sources.manifest import Manifest

    path = new_path(spark, "manifest")
    Manifest("A demo", "de", True).save(spark, path)
    m = Manifest.load(spark, path)
    return spark.createDataFrame([(m.description, m.language, m.transliterate, m.query("stra\u00dfe"))], "description string, language string, transliterate boolean, pattern string")
