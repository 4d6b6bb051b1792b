r"""Quality by weak supervision, in DataFrame and SQL functions only.

Rules vote good, bad or abstain on each text. Expectation-maximisation over the counts of vote patterns (at most
2**rules rows, whatever the corpus size) estimates how often each rule votes on good and on bad texts and the share
of bad ones; the posterior probability of good replaces an all-must-pass filter. The whole estimation is one SQL
expression on one row.

Words are [^\x20\x09-\x0D]+, lines are cut at \n. Edge cases: a null or empty text has no words, all counts 0 and
fails the base test; in an empty table nothing is estimated and no row comes out; repeated rows count as often as
they occur; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

ROUNDS = 40
#: A text is kept from this posterior on, so one that only lacks good votes stays.
KEEP_FROM = 0.1

#: Share of good and of bad texts a rule votes on before any is seen, by its vote, and for how many texts that counts.
START = {1: (0.95, 0.6), 2: (0.01, 0.3)}
PRIOR_VOTES = 10

#: name, vote (2 bad, 1 good), condition; where it does not hold the rule abstains.
RULES = [
    ("symbols_per_word", 2, "n_symbols > 0.2 * n_words"),
    ("symbols_per_character", 2, "n_symbols > 0.05 * word_chars"),
    ("upper_case", 2, "n_upper > 0.3 * word_chars"),
    ("exclamations", 2, "n_exclaim > 0.3 * n_words"),
    ("cells", 2, "n_cells > 0.2 * n_words"),
    ("repeated_windows", 2, "n_repeat_words > 0.3 * n_words"),
    ("vocabulary", 2, "n_distinct < 0.3 * n_words"),
    ("duplicate_lines", 2, "n_dup_lines > 0.3 * n_lines"),
    ("word_length", 2, "word_chars > 16 * n_words OR word_chars < 2 * n_words"),
    ("sentences", 1, "n_ended >= 0.7 * n_lines AND n_words > 0"),
    ("plain_letters", 1, "n_plain >= 0.75 * word_chars AND n_words > 0"),
]

WINDOWS = "transform(array(words), ws -> transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2])))[0]"

#: Words covered by windows whose hash occurs twice: neighbours in hash order, back in text order, then counted once.
COVERED = """
CASE WHEN size(windows) < 2 THEN 0L
     WHEN size(array_distinct(windows)) = size(windows) THEN 0L
ELSE aggregate(
    sort_array(transform(array(sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i)))),
        s -> transform(filter(s, (e, i) -> coalesce(get(s, i - 1).h = e.h, false) OR coalesce(get(s, i + 1).h = e.h, false)), e -> e.i))[0]),
    struct(0L AS n, -3 AS last),
    (a, x) -> struct(a.n + least(3, x - a.last) AS n, x AS last),
    a -> a.n) END
"""


def without(chars: str) -> str:
    return f"length(text) - length(translate(text, '{chars}', ''))"


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and the counts the rules read. What a lambda reads is bound to its variables, so it is computed once a row."""
    one = docs.select("doc_id", F.struct(F.lit(0), *carry).alias("carried"), F.coalesce("text", F.lit("")).alias("text"))
    one = one.selectExpr("doc_id", "carried", "text", r"filter(split(text, '[\\t-\\r ]+'), w -> w <> '') AS words", r"filter(split(text, '\\n'), l -> translate(l, ' \t\n\u000b\u000c\r', '') <> '') AS lines")
    one = one.withColumn("windows", F.expr(WINDOWS))
    return one.selectExpr(
        "doc_id", *(f"carried.`{c}` AS `{c}`" for c in carry), "size(words) AS n_words", r"length(translate(text, ' \t\n\u000b\u000c\r', '')) AS word_chars",
        f"{without('#*$%&|<>')} AS n_symbols", "size(lines) - size(array_distinct(lines)) AS n_dup_lines", "size(lines) AS n_lines",
        f"{COVERED} AS n_repeat_words", "size(array_distinct(words)) AS n_distinct", f"{without('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS n_upper",
        f"{without('!')} AS n_exclaim", f"{without('|')} AS n_cells", r"size(filter(lines, l -> rtrim(l) rlike '[.?]$')) AS n_ended",
        r"length(translate(text, ' \t\n\u000b\u000c\rABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#*$%&|<>!?.,;:', '')) AS n_plain",
    )


def votes(measured: DataFrame) -> DataFrame:
    """Adds pattern: bit j is set where rule j votes."""
    return measured.withColumn("pattern", F.expr(" + ".join(f"IF({when}, {1 << j}, 0)" for j, (_, _, when) in enumerate(RULES))))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p_good) from (pattern, n): expectation-maximisation in one row."""
    m = len(RULES)
    array = lambda xs: f"array({', '.join(f'{x}D' for x in xs)})"
    good, bad = (array(START[vote][k] for _, vote, _ in RULES) for k in (0, 1))
    digits = f"transform(sequence(0, {m - 1}), j -> cast(getbit(pattern, j) AS int))"
    told = "IF(v = 1, ln(s.bad[a.j]) - ln(s.good[a.j]), ln(1D - s.bad[a.j]) - ln(1D - s.good[a.j]))"
    p_bad = f"1D / (1D + exp(-greatest(-700D, least(700D, aggregate(e.d, struct(ln(s.prior) - ln(1D - s.prior) AS t, 0 AS j), (a, v) -> struct(a.t + {told} AS t, a.j + 1 AS j), a -> a.t)))))"
    weight = lambda w: f"aggregate(x, 0D, (t, e) -> t + e.n * {w})"
    rate = lambda w, start: f"transform({start}, (r, k) -> ({weight(f'{w} * e.d[k]')} + {PRIOR_VOTES}D * r) / ({weight(w)} + {PRIOR_VOTES}D))"
    step = f"""transform(array(transform(found, e -> struct(e.n AS n, e.d AS d, {p_bad} AS b))), x -> struct(
        ({weight('e.b')} + 0.1D * {PRIOR_VOTES}D) / ({weight('1D')} + {PRIOR_VOTES}D) AS prior,
        {rate('(1D - e.b)', good)} AS good, {rate('e.b', bad)} AS bad))[0]"""
    model = f"aggregate(sequence(1, {rounds}), struct(0.1D AS prior, {good} AS good, {bad} AS bad), (s, i) -> {step})"
    row = patterns.selectExpr("pattern", "cast(n AS double) AS n", f"{digits} AS d").groupBy().agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "d"))).alias("found"))  # at most 2**rules
    row = row.where("size(found) > 0").withColumn("s", F.expr(model))
    return row.selectExpr("s", "inline(found)").selectExpr("pattern", f"1D - {p_bad.replace('e.d', 'd')} AS p_good")


def score(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The measures of each document with base_failed, p_good and kept, and the carried columns.

    The measures are kept in a checkpoint, which also stops a later filter from being pushed below them.
    """
    measured = cut(votes(measures(docs, carry)))
    model = estimate(measured.groupBy("pattern").agg(F.count("*").alias("n")))
    judged = measured.join(F.broadcast(model), "pattern", "left")  # at most 2**rules rows
    judged = judged.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in counts), "base_failed", "kept", "p_good")
