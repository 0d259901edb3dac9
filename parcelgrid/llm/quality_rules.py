"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one measure of a text and votes good, bad or not at all. How often a rule is
right on good and on bad texts is not known; expectation-maximisation estimates both, and the
share of good texts, from the votes alone (independent votes given the class, and light Beta
priors that hold a rule's accuracy off 0 and 1 and name the majority class "good"). The verdict
is the posterior probability of "good".

The model is fitted on the count of every pattern of votes: at most 3 ** len(RULES) rows whatever
the input, which cover all documents. A round of the estimation is one aggregation over those
counts; only its sums, a few numbers for each rule, come to the driver.

All measures come from expressions in one pass over the text; no row is exploded, and only the
measures of a document are shuffled or written.

Defined results: a null or blank text has no words, so all measures are 0 and base_failed is
true; a null doc_id is passed on; repeated rows are measured and returned each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import BLANKS, SPACE, let, text_or_empty

MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
KEEP_FROM = 0.5

#: Frequent function words of the four languages.
STOP_WORDS = """
the of and to in a is that it for on was be as with by this
der die das und ist nicht von mit den zu ein für auf sich
de la le les et des un une du que en pour dans est qui par
el los las se no por con una su para es lo del al
""".split()


def _windows(hashes: Column) -> Column:
    """Hashes of all windows of WINDOW words."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that are found twice or more.

    Sorted by hash, a repeated window has an equal neighbour; in order of position, a window adds
    the words that the one before it did not cover.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        same = F.filter(
            F.transform(
                rows,
                lambda r, k: F.when(
                    (F.get(rows, k - 1)["h"] == r["h"]) | (F.get(rows, k + 1)["h"] == r["h"]), r["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.aggregate(
            F.array_sort(same),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
            ),
        )["n"]

    return let(placed, repeated)


def n_repeat_words(words: Column) -> Column:
    """Words in windows found twice or more; most texts have none and need no sort."""
    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            _windows(h),
            lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(_covered(ws)),
        ),
    )
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(counted)


def _chars_left(text: str, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_letters", "n_capitals", "n_stops", "n_ended", "n_distinct",
)


def measures(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id, MEASURES (long) and ``carried`` as ``row`` for every row."""
    row = F.lit(0) if carried is None else carried
    text = docs.select(
        F.col("doc_id").cast("long"),
        row.alias("row"),
        text_or_empty().alias("text"),
        F.btrim(text_or_empty(), F.lit(BLANKS)).alias("bare"),
    )
    split = text.select(
        "doc_id",
        "row",
        F.when(F.col("bare") == "", F.array().cast("array<string>"))
        .otherwise(F.split("bare", f"[{SPACE}]+", -1))
        .alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        (F.length("text") - _chars_left("text", f"[^{SPACE}]+")).cast("long").alias("word_chars"),
        _chars_left("text", "[^#*$%&|<>]+").alias("n_symbols"),
        _chars_left("text", "\\P{L}+").alias("n_letters"),
        _chars_left("text", "[^A-ZÀ-ÖØ-Þ]+").alias("n_capitals"),
    )
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    found = split.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        "n_letters",
        "n_capitals",
        F.size(F.array_intersect(F.col("words"), stops)).cast("long").alias("n_stops"),
        F.size(F.filter("lines", lambda x: x.rlike(f"[.!?][{SPACE}]*\\z"))).cast("long").alias("n_ended"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    return found


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where its condition holds, and abstains on texts of under ``words`` words."""

    name: str
    good: str
    bad: str
    words: int = 1


RULES = (
    Rule("length", "n_words >= 40", "n_words < 15"),
    Rule("word_size", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols <= 2 * n_words", "10 * n_symbols > 2 * n_words"),
    Rule("letters", "100 * n_letters >= 95 * word_chars", "100 * n_letters < 91 * word_chars"),
    Rule("repeated_lines", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "100 * n_repeat_words <= 2 * n_words", "10 * n_repeat_words > n_words"),
    Rule("function_words", "n_stops >= 5", "n_stops <= 1", 30),
    Rule("capitals", "100 * n_capitals <= 10 * word_chars", "100 * n_capitals > 30 * word_chars"),
    Rule("sentence_ends", "2 * n_ended >= n_lines", "10 * n_ended <= n_lines"),
    Rule("variety", "n_distinct * 3 >= n_words", "n_distinct * 10 < n_words", 30),
)


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures and a column ``votes``: a letter g, b or - for each rule."""
    letters = [
        f"CASE WHEN n_words < {r.words} THEN '-' WHEN {r.bad} THEN 'b' WHEN {r.good} THEN 'g' ELSE '-' END"
        for r in rules
    ]
    return measured.withColumn("votes", F.expr(f"concat({', '.join(letters)})"))


@dataclass(frozen=True)
class Model:
    """share: of good texts; right_good, right_bad: how often a rule that votes is right on either."""

    share: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def posterior(self) -> Column:
        """The probability of "good" given the column ``votes``."""
        odds = F.log(F.lit(self.share / (1 - self.share)))
        for k, (g, b) in enumerate(zip(self.right_good, self.right_bad, strict=True)):
            vote = F.substring("votes", k + 1, 1)
            odds = odds + F.when(vote == "g", F.log(F.lit(g / (1 - b)))).when(vote == "b", F.log(F.lit((1 - g) / b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, n_rules: int, rounds: int = 30, enough: float = 1e-4) -> Model:
    """Expectation-maximisation over (votes, n)."""
    model = Model(0.85, (0.97,) * n_rules, (0.4,) * n_rules)
    seen = [f"substring(votes, {k + 1}, 1)" for k in range(n_rules)]
    for _ in range(rounds):
        weighed = patterns.withColumn("p", model.posterior())
        sums = [F.sum("n").alias("n"), F.expr("sum(n * p)").alias("good")]
        for k, vote in enumerate(seen):
            for name, held in (("gg", "p"), ("gb", "(1 - p)")):
                sums.append(F.expr(f"sum(n * {held} * int({vote} = 'g'))").alias(f"{name}{k}"))
            for name, held in (("bg", "p"), ("bb", "(1 - p)")):
                sums.append(F.expr(f"sum(n * {held} * int({vote} = 'b'))").alias(f"{name}{k}"))
        s = weighed.agg(*sums).first()
        if not s["n"]:
            return model
        # priors as if seen before: 20 votes, 19 of them right on good texts; 10, 4 right on bad texts
        right_good = tuple((s[f"gg{k}"] + 19) / (s[f"gg{k}"] + s[f"bg{k}"] + 20) for k in range(n_rules))
        right_bad = tuple((s[f"bb{k}"] + 4) / (s[f"gb{k}"] + s[f"bb{k}"] + 10) for k in range(n_rules))
        share = (s["good"] + 17) / (s["n"] + 20)
        moved = max(
            abs(a - b)
            for a, b in zip((share, *right_good, *right_bad), (model.share, *model.right_good, *model.right_bad), strict=True)
        )
        model = Model(share, right_good, right_bad)
        if moved < enough:
            break
    return model


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carried: Column | None = None) -> DataFrame:
    """doc_id, the measures, votes, base_failed, posterior, kept and ``carried`` as ``row`` for every row.

    The measures are written with what is carried, so the texts are read once and never joined.
    """
    voted = materialise(votes(measures(docs, carried), rules))
    patterns = materialise(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1))
    posterior = F.round(fit(patterns, len(rules)).posterior(), 6)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "posterior": posterior}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judged(docs, carried=F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where("kept").select("row.*")
