r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern; ``regexp_extract_all`` gives its leftmost non-overlapping matches and ``split`` by the same pattern
the text between them, whose lengths in code points give the places. Validators are expressions: parts of an address up
to 255, Luhn sums of card numbers, mod-97 of account numbers. A span's score is its kind's prior, plus the bonus of a
checksum, plus the bonus of a context word in the text right before it; spans from ``least`` on are reported. Emails,
addresses, cards and phone numbers that pass their validator always reach it; account numbers (iban) need their checksum,
and national numbers (ssn) and dates of birth (dob) a context word.

Only DataFrame functions are used. A text without the characters a kind needs skips its pattern. The patterns are
possessive and start at run borders, so their time is linear in the text, whatever its length.

Defined cases: null text is empty: no spans; repeated rows are judged alike; other columns are ignored by ``spans`` and kept
by ``redacted``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap test of the text, SQL on ``text``
    valid: str  # SQL on ``s.m``, the match
    prior: float
    checksum: float = 0.0
    words: str = ""  # context words, a pattern on the lower-cased text before the span


_DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
_LUHN = (f"aggregate(transform(sequence(1, length({_DIGITS})), i -> CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1) AS INT) * (2 - i % 2)), 0, "
         "(a, x) -> a + CASE WHEN x > 9 THEN x - 9 ELSE x END) % 10 = 0")
_IBAN = "replace(s.m, ' ', '')"
_MOD97 = (f"aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (a, x) -> CASE WHEN x BETWEEN '0' AND '9' "
          "THEN (a * 10 + CAST(x AS INT)) % 97 WHEN x BETWEEN 'A' AND 'Z' THEN (a * 100 + ascii(x) - 55) % 97 ELSE a END) = 1")
_BYTES = "forall(split(s.m, '[.]'), x -> CASE WHEN length(trim(LEADING '0' FROM x)) > 3 THEN false ELSE coalesce(try_cast(x AS INT), 0) <= 255 END)"

#: The first four are the kinds of the query's contract; their patterns are fixed values up to possessive quantifiers.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", "true", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "instr(text, '.') > 0 AND text RLIKE '[0-9][.][0-9]'",
         _BYTES, 0.6, 0.0, "ip|address|server|host"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "text RLIKE '[0-9](?:[ -]?[0-9]){12}'",
         f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0.5, 0.3, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.6, 0.0, "phone|tel|call|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+\b", "text RLIKE '[A-Z][A-Z][0-9][0-9]'", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}",
         0.3, 0.4, "iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "text RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "true", 0.3, 0.0,
         "ssn|social security|tax id"),
    Kind("dob", r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])", "text RLIKE '[0-9]{4}-[0-9]{2}-[0-9]{2}'", "true", 0.3, 0.0, "born|birth|geboren|nacido"),
]
BASE = ("email", "ip", "card", "phone")
CONTEXT_BONUS, CONTEXT_CHARS = 0.3, 40


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _found(kind: Kind, text: str, least: float) -> str:
    """SQL: an array of (kind, start, end, score, match) of one kind, in order. ``text`` names a non-null string column."""
    p = _quoted(kind.pattern)
    pairs = f"filter(arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1)), x -> x.`0` IS NOT NULL)"
    placed = (f"aggregate({pairs}, named_struct('at', 0L, 'out', CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, m: STRING, before: STRING>>)), "
              "(a, x) -> named_struct('at', a.at + char_length(x.`1`) + char_length(x.`0`), 'out', concat(a.out, array(named_struct("
              "'start', a.at + char_length(x.`1`), 'end', a.at + char_length(x.`1`) + char_length(x.`0`), 'm', x.`0`, 'before', "
              f"lower(right(x.`1`, {CONTEXT_CHARS})))))), a -> a.out)")
    score = f"{kind.prior}D + {kind.checksum}D" + (f" + CASE WHEN s.before RLIKE '{kind.words}' THEN {CONTEXT_BONUS}D ELSE 0D END" if kind.words else "")
    out = (f"transform(filter({placed}, s -> {kind.valid}), s -> named_struct('kind', '{kind.name}', 'start', s.start, 'end', s.end, 'score', {score}, 'match', s.m))")
    return f"CASE WHEN {kind.needs.replace('text', text)} THEN filter({out}, s -> s.score >= {least}D) ELSE {EMPTY} END"


EMPTY = "CAST(array() AS ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT, score: DOUBLE, match: STRING>>)"


def with_spans(docs: DataFrame, least: float = 0.5, text: str = "text", into: str = "__pii_spans") -> DataFrame:
    """Add ``into``: an array of spans per kind, in the order of KINDS."""
    d = docs.withColumn("__pii_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(into, F.array(*[F.expr(_found(k, "__pii_text", least)) for k in KINDS]))
    return d.drop("__pii_text")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and its spans (kind, start, end, score, match), ordered by kind and start."""
    return with_spans(docs.select("doc_id", "text"), least).select("doc_id", F.flatten("__pii_spans").alias("spans"), "__pii_spans")


def digests(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    d = spans(docs, least)
    names = [k.name for k in KINDS]
    base = F.flatten(F.slice("__pii_spans", 1, len(BASE)))
    return d.select("doc_id", *[F.size(F.col("__pii_spans")[names.index(k)]).cast("long").alias(f"n_{k}") for k in BASE],
                    F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of docs; every span of personal data in ``text`` is replaced by its kind in brackets.

    Overlapping spans are replaced together under the kind of the first.
    """
    d = with_spans(docs, least)
    one = F.array_sort(F.flatten("__pii_spans"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)))
    d = d.withColumn("__pii_spans", one)
    text = F.expr("""
        CASE WHEN size(__pii_spans) = 0 THEN text ELSE aggregate(__pii_spans, named_struct('at', 0L, 'out', CAST(array() AS ARRAY<STRING>)),
          (a, s) -> CASE WHEN s.start < a.at THEN named_struct('at', greatest(a.at, s.end), 'out', a.out)
            ELSE named_struct('at', s.end, 'out', concat(a.out, array(substr(text, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), concat('[', s.kind, ']')))) END,
          a -> array_join(concat(a.out, array(substr(text, CAST(a.at + 1 AS INT)))), '')) END""")
    return d.withColumn("text", text).drop("__pii_spans").select(*docs.columns)
