"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document gets a few counts, which give four rates. For each language and source
the distribution of each rate is kept as a mergeable sketch: counts by logarithmic
bucket (64 exact small values, then 32 buckets per power of two, so a quantile is off
by at most 1/32 of itself). Sketches are sums, so partial ones combine map-side and a
hot source costs no more than any other. A group's quantiles are drawn towards those
of its language, and these towards the corpus's, as if PRIOR rows of the wider one had
been added; so a group of any size has fences of its own and small ones lean on the
wider sketch. A rate farther from its group's median than a multiple of the distance
to an outer quantile rejects the document: fences rise and fall with the group's
spread. The fences are joined back and filter.

Defined results: null and empty texts have no words, so they fail the base rule;
null language or source is a group of its own; very long texts are counted whole;
ties (a rate on its fence) are kept; repeated rows give one result row each; rows of
a group in which nothing passes the base rule have null fences; an empty table gives
no rows; further columns pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import WORD_GAP, small, stored

REPEAT_WINDOW = 8
MIN_WORDS = 20
#: Rates are counted in parts of so many.
SCALE = 10_000
#: Rows of the wider group that a group's quantiles are mixed with.
PRIOR = 200
#: For each rate: percent point of the lower fence's quantile (none: no lower fence) and of the upper one's, the
#: multiple of the distance from the median, and the least distance, which only keeps a fence from closing on a group whose rows are all alike.
RULES: dict[str, tuple[int | None, int, int, int]] = {
    "symbol_rate": (None, 75, 6, 15),
    "dup_line_rate": (None, 98, 3, 60),
    "repeat_rate": (None, 98, 3, 60),
    "word_length": (25, 75, 8, 16),
}
RATES = tuple(RULES)
LOWER = tuple(r for r in RATES if RULES[r][0] is not None)
SYMBOLS = "#*$%&|<>"


def stats(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text, one row per row.

    Repeated windows are found in the row itself: window hashes are compared by one
    sort of a text that has any, and the covered words are summed from the gaps
    between marked windows.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.filter(F.split(t, WORD_GAP), lambda w: w != "").alias("words"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda line: F.regexp_replace(line, WORD_GAP, "") != "").alias("lines"),
        F.length(F.regexp_replace(t, WORD_GAP, "")).cast("long").alias("word_chars"),
    )
    k = REPEAT_WINDOW
    two = one.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    three = two.select(
        "*", F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("sorted")
    ).drop("hashes")
    four = three.select(
        "*",
        F.sort_array(F.transform(
            F.filter(F.col("sorted"), lambda x, i: (x["h"] == F.get(F.col("sorted"), i - 1)["h"]) | (x["h"] == F.get(F.col("sorted"), i + 1)["h"])), lambda x: x["at"]
        )).alias("starts"),
    ).drop("sorted")
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("starts", i + 1), p + k) - p)), F.lit(0), lambda a, x: a + x
    )
    return four.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def rates(counted: DataFrame) -> DataFrame:
    """The rates as whole numbers, exact on every engine: shares in parts of SCALE, the mean length of words in hundredths."""
    per = lambda part, of, scale=SCALE: F.expr(f"cast({scale} * {part} div greatest({of}, 1) as bigint)")
    return counted.select(
        "*", per("n_symbols", "word_chars").alias("symbol_rate"), per("n_dup_lines * 8", "n_words").alias("dup_line_rate"), per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("word_chars", "n_words", 100).alias("word_length"), F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
    )


def bucket(x: Column) -> Column:
    """The least value of x's bucket: x with all but its six leading bits cleared."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketch(rated: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: rows (by..., rate, bucket, n). Merging is adding ``n``."""
    long = rated.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in RATES])).alias("x"))
    return long.select(*by, "x.rate", "x.bucket").groupBy(*by, "rate", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rate, rows, low, mid, up) of sketches: each point is the least bucket that reaches its rank."""
    part = Window.partitionBy(*by, "rate")
    ranked = sketches.select("*", F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(part).alias("rows"))

    def point(percent: Column) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("rows"), F.col("bucket")))

    of = lambda k: F.create_map(*[F.lit(x) for r in RATES for x in (r, RULES[r][k] or 50)])[F.col("rate")]
    return ranked.groupBy(*by, "rate").agg(F.max("rows").alias("rows"), point(of(0)).alias("low"), point(F.lit(50)).alias("mid"), point(of(1)).alias("up"))


def _drawn(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """Quantiles mixed with PRIOR rows of the wider group's."""
    other = wider.select(*on, *[F.col(c).alias(f"w_{c}") for c in ("low", "mid", "up")])
    mixed = [F.expr(f"(rows * {c} + {PRIOR} * w_{c}) div (rows + {PRIOR})").alias(c) for c in ("low", "mid", "up")]
    return own.join(other, on).select(*[c for c in own.columns if c not in ("low", "mid", "up")], *mixed)


def fences(sketches: DataFrame) -> DataFrame:
    """(g_lang, g_source, fences) of the sketches of all groups: ``high_`` of each rate and ``low_`` where there is a lower one."""
    own = quantiles(sketches, ["g_lang", "g_source"])
    by_lang = quantiles(merge(sketches, ["g_lang"]), ["g_lang"])
    corpus = quantiles(merge(sketches, []), [])
    q = _drawn(own, _drawn(by_lang, corpus, ["rate"]), ["g_lang", "rate"])
    made = []
    for r, (low, _, reach, least) in RULES.items():
        here = F.col("rate") == r
        made.append(F.max(F.when(here, F.col("mid") + reach * F.greatest(F.col("up") - F.col("mid"), F.lit(least)))).cast("long").alias(f"high_{r}"))
        if low is not None:
            made.append(F.max(F.when(here, F.col("mid") - reach * F.greatest(F.col("mid") - F.col("low"), F.lit(least)))).cast("long").alias(f"low_{r}"))
    return q.groupBy("g_lang", "g_source").agg(*made)


def filter_quality(documents: DataFrame) -> DataFrame:
    """Base counts, verdicts and the fences used, one row per row of ``documents``.

    The counts are stored once in the shared folder, as both the sketches and the
    joined filter read them; texts are read once.
    """
    rated = stored(rates(stats(documents)), "quality")
    # Groups meet by a text that can't be null: marked, so that no two pairs look alike.
    keyed = rated.withColumn("g_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))).withColumn("g_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    fine = stored(sketch(keyed.where(~F.col("base_failed")), ["g_lang", "g_source"]), "quality-sketch")
    out = keyed.join(small(stored(fences(fine), "quality-fences")), ["g_lang", "g_source"], "left")
    passed = ~F.col("base_failed")
    for r in RATES:
        passed = passed & F.coalesce(F.col(r) <= F.col(f"high_{r}"), F.lit(False))
    for r in LOWER:
        passed = passed & F.coalesce(F.col(r) >= F.col(f"low_{r}"), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", passed.alias("kept"), *RATES, *[f"high_{r}" for r in RATES], *[f"low_{r}" for r in LOWER],
    )


def oracle() -> str:
    """The same filter of ``documents`` as DuckDB SQL."""
    gap, k = r"[\x20\x09-\x0D]+", REPEAT_WINDOW
    levels = {"own": ["lang", "source"], "wide": ["lang"], "corpus": []}

    def of(k: int) -> str:
        return "CASE rate " + " ".join(f"WHEN '{r}' THEN {RULES[r][k] or 50}" for r in RATES) + " END"

    ctes = []
    for name, by in levels.items():
        cols = "".join(f"{c}, " for c in by)
        part = f"PARTITION BY {cols}rate"
        points = ", ".join(f"min(CASE WHEN 100 * upto >= {p} * total THEN bucket END) AS {c}" for c, p in (("low", of(0)), ("mid", "50"), ("up", of(1))))
        ctes.append(f"""
{name}_bins AS (SELECT {cols}rate, bucket, count(*) AS n FROM long GROUP BY {cols}rate, bucket),
{name}_cum AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total FROM {name}_bins),
{name}_q AS (SELECT {cols}rate, max(total) AS total, {points} FROM {name}_cum GROUP BY {cols}rate)""")
    mix = lambda a, b: ", ".join(f"({a}.total * {a}.{c} + {PRIOR} * {b}.{c}) // ({a}.total + {PRIOR}) AS {c}" for c in ("low", "mid", "up"))
    made = [f"max(CASE WHEN rate = '{r}' THEN mid + {reach} * greatest(up - mid, {least}) END)::BIGINT AS high_{r}" for r, (_, _, reach, least) in RULES.items()]
    made += [f"max(CASE WHEN rate = '{r}' THEN mid - {RULES[r][2]} * greatest(mid - low, {RULES[r][3]}) END)::BIGINT AS low_{r}" for r in LOWER]
    ctes.append(f"""
lang_q AS (SELECT w.lang, w.rate, {mix('w', 'c')} FROM wide_q w JOIN corpus_q c USING (rate)),
drawn AS (SELECT o.lang, o.source, o.rate, {mix('o', 'l')} FROM own_q o JOIN lang_q l ON o.rate = l.rate AND o.lang IS NOT DISTINCT FROM l.lang),
f AS (SELECT lang, source, {', '.join(made)} FROM drawn GROUP BY lang, source)""")
    tests = [f"coalesce(s.{r} <= f.high_{r}, false)" for r in RATES] + [f"coalesce(s.{r} >= f.low_{r}, false)" for r in LOWER]
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{gap}'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {k - 2}), lambda i: struct_pack(pos := i, body := array_to_string(words[i:i + {k - 1}], ' ')))) AS w FROM d WHERE len(words) >= {k}),
marked AS (SELECT doc_id, w.pos AS pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w.body) > 1),
gaps AS (SELECT doc_id, least({k}, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, {k})) AS g FROM marked),
repeats AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{gap}', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda s: regexp_replace(s, '{gap}', '', 'g') <> '')) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda s: regexp_replace(s, '{gap}', '', 'g') <> ''))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN repeats r ON r.doc_id = d.doc_id),
s AS (SELECT *, {SCALE} * n_symbols // greatest(word_chars, 1) AS symbol_rate, {SCALE} * n_dup_lines * 8 // greatest(n_words, 1) AS dup_line_rate, {SCALE} * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
long AS (SELECT lang, source, rate, ((value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0)) AS bucket
  FROM (SELECT lang, source, unnest([{', '.join(f"'{r}'" for r in RATES)}]) AS rate, unnest([{', '.join(RATES)}]) AS value FROM s WHERE NOT base_failed) x),
{','.join(ctes)}
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  NOT s.base_failed AND {' AND '.join(tests)} AS kept,
  {', '.join(f's.{r}' for r in RATES)}, {', '.join(f'f.high_{r}' for r in RATES)}, {', '.join(f'f.low_{r}' for r in LOWER)}
FROM s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source"""
