"""Op 2, quality rules: counts of words, symbols and repeats, and divergence from language references.

Each document's histograms of character classes and of common words are compared with those of every reference language
by the Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. A reference is the mean histogram of all
documents of that language that pass the base rules. Documents too short for a histogram aren't judged by it.

Only DataFrame functions: one row a document throughout, repeats are found by sorting an array of hashes inside the row,
with words compared before they count. The references are a row a language.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import WS, checkpoint

COMMON = {
    "en": ("the", "of", "and", "to", "in", "a"),
    "de": ("der", "die", "und", "das", "den", "von"),
    "fr": ("le", "la", "les", "et", "des", "est"),
    "es": ("el", "que", "los", "las", "una", "y"),
}
CLASSES = ("lower", "upper", "letter", "digit", "mark", "symbol", "other")
MARKS, SYMBOLS = r".,;:!?'\"()\-", "#*$%&|<>"
#: Code points and words that a histogram needs; distances above which a document goes.
MIN_CHARS, MIN_WORDS = 200, 100
MOST_CHARS, MOST_WORDS = 0.35, 0.2
POSITION = 24


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def _windows(w: Column, n: Column) -> tuple[Column, Callable[[Column], Column], int]:
    """Hashes of the windows of three words, with their place in the low bits, sorted; what gets a word; the place's mask."""
    mask = (1 << POSITION) - 1
    at = lambda i: F.get(w, i.cast("int"))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(at(i), at(i + 1), at(i + 2)), POSITION).bitwiseOR(i.cast("long")))
    return F.when(n >= 3, F.sort_array(packed)), at, mask


def metrics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars and common (counts by
    class and by common word); and the columns named in ``carry``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("_lang"), text.alias("_text"), *(F.col(c).alias(f"_own_{c}") for c in carry))
    df = df.withColumn("_w", F.filter(F.split("_text", f"[{WS}]+"), lambda x: x != ""))
    df = df.withColumn("_n", F.size("_w"))
    packed, at, mask = _windows(F.col("_w"), F.col("_n"))
    df = df.withColumn("_s", packed)
    s = F.col("_s")

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(F.lit(mask)), b.bitwiseAND(F.lit(mask))
        return (F.shiftright(a, POSITION) == F.shiftright(b, POSITION)) & (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))

    last = F.size(s) - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(F.when(k > 0, same(F.get(s, k), F.get(s, k - 1))), F.lit(False)) | F.coalesce(F.when(k < last, same(F.get(s, k), F.get(s, k + 1))), F.lit(False)))
    where = F.transform(twice, lambda k: F.get(s, k).bitwiseAND(F.lit(mask)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(where, lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    df = df.withColumn("_lines", lines).withColumn("_rest", F.regexp_replace("_text", f"[a-z{WS}]+", ""))
    words = [x for group in COMMON.values() for x in group]
    df = df.withColumn("_common", F.concat(F.lit(" "), F.concat_ws("  ", F.filter("_w", lambda x: x.isin(words))), F.lit(" ")))
    rest, common = F.col("_rest"), F.col("_common")
    word_chars = F.length(F.translate("_text", " \t\n\x0b\x0c\r", ""))
    upper, digit, mark, symbol = (_without(rest, c) for c in ("A-Z", "0-9", MARKS, SYMBOLS))
    letter = _without(F.regexp_replace(rest, "[A-Z]+", ""), r"\p{L}\p{M}")
    counts = [word_chars - F.length(rest), upper, letter, digit, mark, symbol]
    df = df.withColumn("_counts", F.array(*counts)).withColumn("_chars", word_chars)
    other = F.col("_chars") - F.aggregate("_counts", F.lit(0), lambda a, b: a + b)
    each = [((F.length(common) - F.length(F.replace(common, F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("int") for x in words]
    long = lambda c: c.cast("long")
    df = df.select(
        "doc_id", "_lang", long(F.col("_n")).alias("n_words"), long(F.col("_chars")).alias("word_chars"), long(F.get("_counts", F.lit(5))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.when(F.col("_n") >= 3, covered).otherwise(0)).alias("n_repeat_words"),
        F.concat("_counts", F.array(other)).alias("_hist"), F.array(*each).alias("_each"), *(F.col(f"_own_{c}").alias(f"_own_{c}") for c in carry),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def _common_shares(lang: str) -> Column:
    """Of each common word of the language, and of all other words."""
    k = [x for group in COMMON.values() for x in group].index(COMMON[lang][0])
    own = F.slice("_each", k + 1, len(COMMON[lang]))
    some = F.aggregate(own, F.lit(0), lambda a, b: a + b)
    return _shares(F.concat(own, F.array((F.col("n_words") - some).cast("int"))), F.col("n_words"))


def references(found: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language, over all its documents that pass the base rules. A row a language."""
    out = {}
    n_c, n_w = len(CLASSES), len(next(iter(COMMON.values()))) + 1
    good = found.where(~F.col("base_failed") & F.col("_lang").isin(list(COMMON)) & (F.col("word_chars") > 0))
    shares = [F.avg(F.get(_shares(F.col("_hist"), F.col("word_chars")), F.lit(i))) for i in range(n_c)]
    for lang in COMMON:
        shares += [F.avg(F.when(F.col("_lang") == lang, F.get(_common_shares(lang), F.lit(i)))) for i in range(n_w)]
    for r in good.groupBy("_lang").agg(*(s.alias(f"x{i}") for i, s in enumerate(shares))).collect():  # four rows at most
        k = n_c + n_w * list(COMMON).index(r["_lang"])
        out[r["_lang"]] = ([r[f"x{i}"] for i in range(n_c)], [r[f"x{i}"] for i in range(k, k + n_w)])
    return out


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance to a fixed histogram."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log(v / m)).otherwise(0.0)
        return part(x) + part(y)

    total = F.aggregate(F.zip_with(p, F.array(*(F.lit(float(x)) for x in q)), term), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total / (2 * math.log(2)), F.lit(0.0)))


def judged(found: DataFrame, refs: dict[str, tuple[list[float], list[float]]], most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Adds language, char_distance, word_distance (null where the text is too short) and kept."""
    best = None
    for lang, (chars, common) in sorted(refs.items()):
        c = F.when(F.col("word_chars") >= MIN_CHARS, _distance(_shares(F.col("_hist"), F.col("word_chars")), chars))
        w = F.when(F.col("n_words") >= MIN_WORDS, _distance(_common_shares(lang), common))
        x = F.struct((F.coalesce(c, F.lit(0.0)) + F.coalesce(w, F.lit(0.0))).alias("sum"), F.lit(lang).alias("language"), c.alias("c"), w.alias("w"))
        best = x if best is None else F.least(best, x)
    if best is None:
        found = found.withColumns({"language": F.lit(None).cast("string"), "char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    else:
        found = found.withColumn("_best", best).withColumns({"language": F.col("_best.language"), "char_distance": F.col("_best.c"), "word_distance": F.col("_best.w")})
    far = (F.coalesce("char_distance", F.lit(0.0)) > most_chars) | (F.coalesce("word_distance", F.lit(0.0)) > most_words)
    return found.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs. Null and empty texts have no words and fail; repeated rows are judged alike; without
    any document that passes the base rules there are no references, and the base rules decide."""
    found = checkpoint(metrics(docs))  # counts only
    near = (F.round(c, 6).alias(c) for c in ("char_distance", "word_distance"))
    return judged(found, references(found)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language", *near)


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    ws = r"[^\x20\x09-\x0D]"
    count = lambda chars, of="t": f"length(regexp_replace({of}, '[^{chars}]', '', 'g'))"
    words = {lang: "[" + ", ".join(f"len(list_filter(ws, lambda x: x = '{w}'))" for w in group) + "]" for lang, group in COMMON.items()}
    common = " ".join(f"WHEN '{lang}' THEN {x}" for lang, x in words.items())
    marks = MARKS.replace("'", "''").replace("\\", "", 1)

    def distance(p: str, q: str, n: int) -> str:
        part = lambda v, i: f"CASE WHEN {v}[{i}] > 0 THEN {v}[{i}] * ln({v}[{i}] / (({p}[{i}] + {q}[{i}]) / 2)) ELSE 0 END"
        total = " + ".join(f"({part(p, i)} + {part(q, i)})" for i in range(1, n + 1))
        return f"sqrt(greatest(({total}) / (2 * ln(2)), 0))"

    n_w = len(next(iter(COMMON.values()))) + 1
    return rf"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{ws}+') AS ws FROM documents),
tri AS (SELECT r, i, ws[i:i + 2] AS k FROM b, unnest(range(1, len(ws) - 1)) u(i)),
rep AS (SELECT r, k FROM tri GROUP BY r, k HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + d) AS n FROM tri JOIN rep USING (r, k), unnest(range(0, 3)) u(d) GROUP BY r),
c AS (SELECT b.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count(SYMBOLS)} AS n_symbols, coalesce(cov.n, 0) AS n_repeat_words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS ls,
      [{count("a-z")}, {count("A-Z")}, length(regexp_replace(regexp_replace(t, '[a-zA-Z]', '', 'g'), '[^\p{{L}}\p{{M}}]', '', 'g')), {count("0-9")}, {count(marks)}, {count(SYMBOLS)}] AS h FROM b LEFT JOIN cov USING (r)),
m AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      list_transform(list_append(h, word_chars - list_sum(h)::BIGINT), lambda x: x / word_chars) AS p FROM c),
o AS (SELECT *, list_transform(list_append(f, n_words - list_sum(f)::BIGINT), lambda x: x / n_words) AS q FROM (SELECT *, CASE lang {common} END AS f FROM m WHERE NOT base_failed AND word_chars > 0 AND lang IN ({", ".join(f"'{x}'" for x in COMMON)}))),
refs AS (SELECT lang, [{", ".join(f"avg(p[{i}])" for i in range(1, len(CLASSES) + 1))}] AS rp, [{", ".join(f"avg(q[{i}])" for i in range(1, n_w + 1))}] AS rq FROM o GROUP BY lang),
own AS (SELECT *, list_transform(list_append(f, n_words - list_sum(f)::BIGINT), lambda x: x / n_words) AS q FROM (SELECT m.*, refs.lang AS l, rp, rq, CASE refs.lang {common} END AS f FROM m, refs)),
d AS (SELECT *, CASE WHEN word_chars >= {MIN_CHARS} THEN {distance("p", "rp", len(CLASSES))} END AS cd, CASE WHEN n_words >= {MIN_WORDS} THEN {distance("q", "rq", n_w)} END AS wd FROM own),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY r ORDER BY coalesce(cd, 0) + coalesce(wd, 0), l) = 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd, 0) <= {MOST_CHARS} AND coalesce(wd, 0) <= {MOST_WORDS} AS kept, l AS language, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM best
"""


ORACLE = _oracle()
