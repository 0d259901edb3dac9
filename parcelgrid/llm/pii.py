"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Patterns run left to right without overlap for each kind. A span that fails its check (Luhn
for cards, mod-97 for account numbers, the ranges of addresses and number lengths) is dropped and
not tried again. Every span has a score: what its pattern alone is worth, more for a passed
checksum, and more if a word of its kind stands within NEAR characters before or after it. Kinds
whose pattern is weak are kept only from a score of KEEP_FROM on.

All patterns are possessive or anchored where they could otherwise start again at every character
of a long run, so the time grows with the text's length only.

Defined results: positions are code points, end exclusive; a null text is empty and has no span;
a null doc_id is passed on; repeated rows are searched each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import let, sums_before, text_or_empty

NEAR = 40
KEEP_FROM = 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` have a Luhn check digit at the end."""

    def right(number: Column) -> Column:
        def one(total: Column, i: Column) -> Column:
            d = F.substring(number, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), one) % 10 == 0

    return let(F.reverse(digits(value)), right)


def mod97(value: Column) -> Column:
    """Whether ``value`` has the ISO 7064 check digits of an account number."""

    def right(number: Column) -> Column:
        moved = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

        def one(rest: Column, c: Column) -> Column:
            letter = F.ascii(c) - 55
            return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + letter) % 97)

        return F.aggregate(F.filter(F.split(moved, "", -1), lambda c: c != ""), F.lit(0), one) == 1

    return let(F.regexp_replace(value, "[^0-9A-Z]+", ""), right)


def in_range(value: Column) -> Column:
    return value.rlike("^(0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\\.|\\z)){4}\\z")


def long_enough(least: int, most: int) -> Callable[[Column], Column]:
    return lambda value: F.length(digits(value)).between(least, most)


def card(value: Column) -> Column:
    return F.when(long_enough(14, 19)(value), luhn(value)).otherwise(False)


def yes(value: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """hint: a cheaper pattern that every text with a match meets. always: kept at any score."""

    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    score: float
    words: str
    always: bool = True


#: The first four patterns, made safe for long runs, and the words near each kind.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", yes, 0.7, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", in_range, 0.5, "ip|host|server|addr|network"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", card, 0.7, "card|visa|master|amex|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", long_enough(10, 15), 0.5, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, 0.6, "iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", yes, 0.3, "ssn|social|security", False),
)
BASE = KINDS[:4]
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>"


def found(text: Column, kind: Kind, rank: int) -> Column:
    """The spans of one kind.

    The text between matches is what a split by the same pattern leaves, so a match starts after
    all pieces and matches before it.
    """

    def spans(matches: Column, gaps: Column, starts: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(gaps, i))
            near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
            score = F.lit(kind.score) + F.when(near.rlike(kind.words), 0.25).otherwise(0.0)
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(m)).alias("end"),
                F.lit(kind.name).alias("kind"),
                m.alias("value"),
                score.alias("score"),
            )

        kept = F.filter(F.transform(matches, span), lambda s: kind.check(s["value"]))
        return kept if kind.always else F.filter(kept, lambda s: s["score"] >= KEEP_FROM)

    def placed(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            sizes = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
            return let(sums_before(sizes), lambda starts: spans(matches, gaps, starts))

        return let(F.split(text, kind.pattern, -1), with_gaps)

    none = F.array().cast(SPAN)
    matched = let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m).cast(SPAN)),
    )
    return F.when(text.rlike(kind.hint), matched).otherwise(none)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and, by kind, the array of its spans, for every row."""
    own = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return own.select("doc_id", *[found(F.col("text"), k, i).alias(k.name) for i, k in enumerate(KINDS)])


def all_spans(kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans of a row of :func:`personal_data`, by start and then kind."""
    return F.array_sort(F.concat(*[F.col(k.name) for k in kinds]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
