"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Column functions only. Where a pattern matches is found from what it matches and what lies between: the lengths of
both, summed up in order, give code point positions. Patterns may start only at the beginning of a run of their first
characters, or right after the last match, which changes no match but keeps long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind, what a text must hold for a look at it, pattern. The first four are the base kinds, in this order.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
}
BASE = ("email", "ip", "card", "phone")
#: Score without context, and words that raise it within CONTEXT code points before the span.
SCORES = {"email": (0.9, "e-?mail|mail|contact|write"), "ip": (0.6, "ip|address|host|server"), "card": (0.8, "card|credit|visa|payment|debit"), "phone": (0.7, "phone|call|tel|mobile|fax"), "iban": (0.9, "iban|account|bank|transfer")}
CONTEXT, BONUS = 40, 0.1


def nearby(words: str) -> str:
    """Pattern of one of the words, by itself, in a text without capitals A-Z."""
    return rf"(?:^|[^a-z0-9_])(?:{words})(?:[^a-z0-9_]|$)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    stripped = F.translate(value, " ", "")
    return F.when(F.length(stripped).between(15, 34), mod_97(stripped)).otherwise(F.lit(False))


def _spans(kind: str, gaps: Column, found: Column) -> Column:
    """array<struct<start, rank, end, kind>> of the valid matches."""
    span = "struct<start:int,rank:int,end:int,kind:string>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        new = F.struct(start.alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["spans"], new)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"), valid(kind, v).alias("ok")))
    return F.aggregate(pairs, first, step)["spans"]


def find_pii(texts: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds an array of (start, rank, end, kind, score), in order of start, kind and end; positions are code points,
    ends exclusive. A null text is an empty one. Spans of different kinds may overlap."""
    p = lambda kind, x: f"__{into}_{kind}_{x}"
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    df = texts.withColumns({p(k, "m"): F.when(whole.contains(sign) if sign else whole.rlike("[0-9][ -]?[0-9]" if k == "card" else "[A-Z]{2}[0-9]{2}"), F.regexp_extract_all(whole, F.lit(pattern), 0)).otherwise(none) for k, (sign, pattern) in PATTERNS.items()})
    df = df.withColumns({p(k, "g"): F.when(F.size(p(k, "m")) > 0, F.split(whole, pattern, -1)).otherwise(none) for k, (_, pattern) in PATTERNS.items()})
    df = df.withColumns({p(k, "s"): _spans(k, F.col(p(k, "g")), F.col(p(k, "m"))) for k in PATTERNS})
    spans = F.array_sort(F.concat(*[F.col(p(k, "s")) for k in PATTERNS]))

    def scored(s: Column) -> Column:
        near = F.substring(whole, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"]))
        near = F.translate(near, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        score = F.lit(0.0)
        for k, (base, words) in SCORES.items():
            score = F.when(s["kind"] == k, base + F.when(near.rlike(nearby(words)), BONUS).otherwise(0.0)).otherwise(score)
        return s.withField("score", score)

    return df.withColumn(into, F.transform(spans, scored)).drop(*[p(k, x) for k in PATTERNS for x in "mgs"])


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its kind in brackets."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores for every row of docs(doc_id, text).

    Counts and the digest cover the base kinds; spans holds all kinds, and scores their scores. A null or empty text
    has none. Repeated rows are scanned each; other columns are ignored.
    """
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("pii", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.col("pii.score").alias("scores"))
