"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined cases: a null or empty text has length 0 and no words, all its ratios are 0,
and the length rule rejects it; a rule whose ``from_words`` exceeds the number of words
doesn't apply; null doc_ids, repeated rows and further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_WORDS = sorted(
    set(
        "the of and to a in is that it for was on are as with be by this from or an at have not"
        " de la le et les des un une du que qui dans pour est sur par avec au aux il elle"
        " der die und das den von zu mit ist im auf für eine ein auch des"
        " el en los se las y por del una lo para no es".split()
    )
)

#: (name, measure, least, most, from_words): documents outside [least, most] are rejected.
RULES: list[tuple[str, str, float | None, float | None, int]] = [
    ("length", "n_chars", 1, None, 0),
    ("words", "n_words", 1, None, 0),
    ("word_length", "mean_word", 1.5, 40.0, 10),
    ("symbols", "symbol_ratio", None, 0.06, 0),
    ("capitals", "upper_ratio", None, 0.4, 10),
    ("stop_words", "stop_ratio", 0.02, None, 100),
    ("repeated_words", "echo_ratio", None, 0.3, 10),
    ("repeated_lines", "repeated_line_ratio", None, 0.6, 20),
]

SYMBOLS = "*#$%&|{}<>!~^=\\"
MEASURES = ("n_chars", "n_words", "mean_word", "symbol_ratio", "upper_ratio", "stop_ratio", "echo_ratio", "repeated_line_ratio")


def parts(text: Column, p: str = "__") -> dict[str, Column]:
    """What the measures are made of, split once: the text without null, its words and its
    lines; ``p`` opens the names."""
    t = F.coalesce(text, F.lit(""))
    return {
        f"{p}text": t,
        f"{p}words": F.filter(F.split(F.lower(t), r"[ \n]+"), lambda w: w != ""),
        f"{p}lines": F.filter(F.split(t, "\n"), lambda x: x != ""),
    }


def measures(p: str = "__") -> dict[str, Column]:
    """Each measure as built-in functions of the columns of ``parts``, without nulls."""
    t, words, lines = F.col(f"{p}text"), F.col(f"{p}words"), F.col(f"{p}lines")
    chars, n, m = F.length(t), F.size(words), F.size(lines)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    symbols = chars - F.length(F.translate(t, SYMBOLS, ""))
    upper = chars - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÇÀÑ", ""))
    spaces = chars - F.length(F.translate(t, " \n", ""))
    return {
        "n_chars": chars.cast("long"),
        "n_words": n.cast("long"),
        "mean_word": over(chars - spaces, n),
        "symbol_ratio": over(symbols, chars),
        "upper_ratio": over(upper, chars),
        "stop_ratio": over(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))), n),
        "echo_ratio": over(F.size(F.filter(pairs, lambda x: x)), n),
        "repeated_line_ratio": over(m - F.size(F.array_distinct(lines)), m),
    }


def once(columns: dict[str, Column]) -> Column:
    """The columns, made by a generator of one row: a filter on them isn't pushed below it,
    so that nothing is computed a second time for the filter."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def broken(rules: list[tuple], prefix: str = "") -> Column:
    """Names of the rules that a row's measures break, one string each, as an array."""
    names = []
    for name, measure, least, most, from_words in rules:
        bad, value = F.lit(False), F.col(prefix + measure)
        if least is not None:
            bad = bad | (value < F.lit(float(least)))
        if most is not None:
            bad = bad | (value > F.lit(float(most)))
        names.append(F.when((F.col(prefix + "n_words") >= from_words) & bad, F.lit(name)))
    return F.array_compact(F.array(*names))


def quality_rules(docs: DataFrame, rules: list[tuple] = RULES, keep_only: bool = True) -> DataFrame:
    """``doc_id``, the measures and ``broken`` (names of broken rules) of each row of ``docs``;
    with ``keep_only`` only of the rows that break none."""
    split = docs.select("doc_id", *[c.alias(k) for k, c in parts(docs["text"]).items()])
    scored = split.select("doc_id", once(measures()))
    scored = scored.withColumn("broken", F.array_join(broken(rules), ","))
    return scored.filter("broken = ''").drop("broken") if keep_only else scored


def keep_good(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """The rows of ``docs``, with their own columns, that break no rule."""
    p = "__"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    split = docs.select(*[docs[c] for c in docs.columns], *[c.alias(k) for k, c in parts(docs["text"], p).items()])
    own = [split[c] for c in docs.columns]
    wide = split.select(*own, once({p + k: c for k, c in measures(p).items()}))
    return wide.filter(F.size(broken(rules, p)) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the documents that pass, with their measures."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    rules = []
    for _, m, least, most, from_words in RULES:
        parts = ([f"{m} < {float(least)}"] if least is not None else []) + ([f"{m} > {float(most)}"] if most is not None else [])
        rules.append(f"NOT (n_words >= {from_words} AND ({' OR '.join(parts)}))")
    drop = lambda chars: f"length(translate(t, {chars}, ''))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(lower(t), '[ \\n]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: x <> '') AS lines FROM d),
m AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(words) AS BIGINT) AS n_words,
  CASE WHEN len(words) > 0 THEN {drop("' ' || chr(10)")} / len(words)::DOUBLE ELSE 0.0::DOUBLE END AS mean_word,
  CASE WHEN length(t) > 0 THEN (length(t) - {drop("'" + SYMBOLS + "'")}) / length(t)::DOUBLE ELSE 0.0::DOUBLE END AS symbol_ratio,
  CASE WHEN length(t) > 0 THEN (length(t) - {drop("'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÇÀÑ'")}) / length(t)::DOUBLE ELSE 0.0::DOUBLE END AS upper_ratio,
  CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: x IN ({stop}))) / len(words)::DOUBLE ELSE 0.0::DOUBLE END AS stop_ratio,
  CASE WHEN len(words) > 0 THEN len(list_filter(list_zip(words, words[2:]), lambda p: p[1] = p[2])) / len(words)::DOUBLE ELSE 0.0::DOUBLE END AS echo_ratio,
  CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines)::DOUBLE ELSE 0.0::DOUBLE END AS repeated_line_ratio
  FROM w)
SELECT * FROM m WHERE {' AND '.join(rules)}
"""


SQL = _sql()
