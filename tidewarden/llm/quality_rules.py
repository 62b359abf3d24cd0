"""Quality rules: a threshold table compiled into Spark projections, without user functions.

``THRESHOLDS`` lists measures with the range a good text lies in, and the number of words or lines
from which on a share says something about a text; shorter texts are not judged by that measure. ``compile_rules`` turns the
table into one Boolean column per rule; a text is kept when the two fixed base rules and all of
the table's rules hold. Everything happens inside the row: no shuffle, no explode.

Defined cases: a null or empty text has no words and fails the base rule; a ratio whose
denominator is 0 counts as 0; repeated rows are judged alike; an empty table gives an empty
result; columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import GAP, free_name, read, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that was for on as with be at by this it from are or an "
    "der die das und in zu den von mit ist des im nicht ein eine auf "
    "le la les de des et un une est que pour dans par sur qui au "
    "el los las del en y que por con una se su es para"
).split()
# Signs around words that are left out before stop words are looked up.
SIGNS = ".,;:!?\"()"
# measure, least, most (None: open), fewest words or lines. Ratios are per word, per line or
# characters per word.
THRESHOLDS = (
    ("chars_per_word", 2.0, 15.0, 1),
    ("symbols_per_word", None, 0.1, 1),
    ("stop_word_share", 0.02, None, 20),
    ("duplicate_line_share", None, 0.3, 4),
    ("bullet_line_share", None, 0.9, 4),
    ("ellipsis_line_share", None, 0.3, 4),
)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "bullet_line_share": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines"),
}


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more, from the sorted windows of one text."""
    window = lambda i: F.struct(
        F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("w"), i.alias("i")
    )
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window))

    def starts(s: Column) -> Column:
        same = lambda k, d: F.get(s, k)["w"] == F.coalesce(F.get(s, k + d)["w"], F.lit(""))
        marked = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.when(same(k, -1) | same(k, 1), F.get(s, k)["i"]),
        )
        return F.filter(marked, lambda x: x.isNotNull())

    # transform over a one-element array binds the sorted windows to a name.
    found = F.get(F.transform(F.array(ordered), starts), F.lit(0))
    covered = F.flatten(F.transform(found, lambda p: F.sequence(p, p + (WINDOW - 1))))
    return F.size(F.array_distinct(covered))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, for every row, all counts the rules are made of."""
    value = text_of(text)
    base = docs.select(*keep, value.alias("_text"), words_of(value).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        "*",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"),
        lines.alias("_lines"),
        words_of(F.lower(F.translate("_text", SIGNS, ""))).alias("_lower"),
    )
    # A window hash met twice is needed for a window met twice; only such texts are looked at
    # closer, by the words themselves.
    windows = F.when(
        F.size("_hash") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_hash") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_hash", i + d) for d in range(WINDOW)]),
        ),
    )
    base = base.select("*", windows.alias("_windows"))
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    facts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _repeat_words()).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("_lower", lambda w: w.isin(*dict.fromkeys(STOP_WORDS))).alias("n_stop_words"),
        count("_lines", lambda x: x.rlike(r"^\s*[-*•]")).alias("n_bullet_lines"),
        count("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("n_ellipsis_lines"),
    )
    # A filter on the counts would be pushed below the projections, with every count spelled out
    # again inside the others; the generator keeps it here.
    base = base.select(*keep, facts.alias("_facts"))
    return base.select(*keep, F.explode_outer(F.array("_facts")).alias("_facts")).select(*keep, "_facts.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def compile_rules(thresholds=THRESHOLDS) -> dict[str, Column]:
    """One Boolean column per row of the table: true where the text breaks the rule."""
    out = {}
    for name, least, most, fewest in thresholds:
        value = _share(*RATIOS[name])
        tests = [value < least] * (least is not None) + [value > most] * (most is not None)
        out[name] = (tests[0] if len(tests) == 1 else tests[0] | tests[1]) & (F.col(RATIOS[name][1]) >= fewest)
    return out


def judge(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``measure`` plus base_failed, kept and the names of the rules broken."""
    rules = compile_rules(thresholds)
    broken = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull()
    )
    judged = measure(docs, text, keep).select("*", base_failed().alias("base_failed"), broken.alias("broken"))
    return judged.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def keep_good(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """The rows whose text passes, unchanged."""
    whole, value = free_name(docs, "_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(value.alias(whole), F.col(f"`{text}`"))
    return judge(rows, thresholds, text, (whole,)).filter("kept").select(f"{whole}.*")


def query(spark, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
    rest = "n_lines n_stop_words n_bullet_lines n_ellipsis_lines"
    return judge(read(spark, sf_dir, "documents")).select(*columns.split(), *rest.split())


def _sql() -> str:
    sides = {n: f"CASE WHEN {w} > 0 THEN {p}::DOUBLE / {w} ELSE 0 END" for n, (p, w) in RATIOS.items()}
    good = []
    for name, least, most, fewest in THRESHOLDS:
        few = f"{RATIOS[name][1]} < {fewest}"
        good += [f"({few} OR {sides[name]} >= {least})"] * (least is not None)
        good += [f"({few} OR {sides[name]} <= {most})"] * (most is not None)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    gap, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
    p AS (SELECT r, words, unnest(range(0, len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW}),
    g AS (SELECT r, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS win FROM p),
    d AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g),
    c AS (SELECT r, count(DISTINCT j) AS n_repeat FROM
            (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM d WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
            length(regexp_replace(text, '{gap}', '', 'g'))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
            len(list_filter(regexp_extract_all(lower(translate(text, '{SIGNS}', '')), '{word}'), lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
            len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•]')))::BIGINT AS n_bullet_lines,
            len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))::BIGINT AS n_ellipsis_lines
          FROM w LEFT JOIN c USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND {' AND '.join(good)} AS kept FROM b"""


QUERIES = {"op6_quality_rules": query}
ORACLES = {"op6_quality_rules": _sql()}
