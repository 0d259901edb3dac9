import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from parcelgrid.llm import pii, queries

#: The contract's patterns as they stand.
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TRICKY = [
    "a@b.c%d@e.f x@y z@w..v q.r+s@t-u.vw.x. @@a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000 12 3", "+1 (415) 555-0100 +49 30 1234 +1234567890123456 +1-",
    "card 4242424242424242 and +1 650 253 0000, mail me@example.com\nhost 10.0.0.1 é\U0001f600 me@x.org", "9" * 5000, "a." * 4000 + "@",
    "x@" + "b." * 9000 + "c", "1 " * 9000, "@" * 3000, "+" * 3000 + "1", "",
]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    found = [(m.start(), k, m.end(), n) for k, (n, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if valid(n, m[0])]
    listed = ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))
    counts = Counter(n for *_, n in found)
    return (*(counts[n] for n, _ in PLAIN), hashlib.sha256(listed.encode()).hexdigest())


def test_base_spans_equal_brute_force(spark, docs, odd_docs, monkeypatch):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(tricky)
    monkeypatch.setattr(queries, "table", lambda *_: table)
    got = queries.op4_pii(spark, "").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, *base(r.text)) for r in table.collect())


def test_checks_and_context(spark):
    texts = [
        ("iban", "account GB82 WEST 1234 5698 7654 32."), ("iban", "DE89370400440532013000"), (None, "GB83 WEST 1234 5698 7654 32"),
        ("ssn", "his social security number is 123-45-6789"), (None, "part 123-45-6789 fits"), (None, "ssn 000-45-6789"),
    ]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(table).collect()}
    for i, (kind, text) in enumerate(texts):
        spans = [s for k in ("iban", "ssn") for s in rows[i][k]]
        assert [s.kind for s in spans] == ([kind] if kind else [])
        assert all(text[s.start : s.end] == s.value for s in spans)
    near = spark.createDataFrame([(1, "call 4242424242424242"), (2, "my card 4242424242424242")], "doc_id long, text string")
    low, high = (r.card[0].score for r in pii.personal_data(near).orderBy("doc_id").collect())
    assert low < high


def test_sums_before(spark):
    from parcelgrid.llm.rows import sums_before

    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(F.array(*[F.lit(k).cast("long") for k in range(n)]).cast("array<bigint>").alias("a"))
        assert row.select(sums_before(F.col("a")).alias("s")).first().s == [sum(range(k)) for k in range(n)]


def test_empty(no_docs):
    assert pii.personal_data(no_docs).count() == 0
