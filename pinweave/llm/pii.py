"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Only built-in functions. A text is split at a pattern's matches; the pieces' and matches' lengths, summed up in turn,
give the spans. Sums run in blocks and texts are cut from blocks, as a list that grows by one in a fold is copied each
time, and characters are counted from a text's start: the work grows with the text, not with its square. The patterns are the plain ones with two changes that keep their matches and make them linear: a run is
only tried from its start (or where the last match ended), and never given back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns


@dataclass(frozen=True)
class Kind:
    """What one kind of span looks like; ``base`` spans need no score."""

    name: str
    pattern: str
    hint: str  # texts without a match of this are not searched
    valid: Callable[[Column], Column]
    base: bool = True
    score: float = 1.0
    words: str = ""


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    each = F.split(F.reverse(digits(x)), "")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number's check digits leave 1: its first four characters go last, A to Z are 10 to 35."""
    plain = F.regexp_replace(x, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(number > 9, 100).otherwise(10) + number) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"


def _size(x: Column, least: int, most: int) -> Column:
    return F.length(digits(x)).between(least, most)


CARD = r"[0-9](?:[\x20-]?[0-9])++"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
#: In the order in which spans are listed.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda x: x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    Kind("card", CARD, r"[0-9]", lambda x: _size(x, 16, 19) & luhn(x)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda x: _size(x, 8, 15)),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", mod97, False, 0.6, "iban|account|konto|compte|cuenta|bank"),
    Kind("short_card", CARD, "[3-6][0-9]", lambda x: x.rlike("^[3-6]") & _size(x, 13, 15) & luhn(x), False, 0.3, "card|visa|amex|karte|carte|tarjeta"),
)
#: Characters before a span in which context words count, what they add, and the score that a span must reach.
CONTEXT, BOOST, LEAST = 40, 0.4, 0.5
SPAN = "struct<kind:string,start:bigint,stop:bigint>"


#: Numbers summed up, and characters of a text held, as one block.
BLOCK, CHARACTERS = 128, 1024


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, whatever number of times it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array of bigint what ``plus`` makes of 0 and all values before it."""
    zero = F.lit(0).cast("bigint")

    def walked(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, state, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def blocked(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(values, i, F.lit(BLOCK)))
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, plus))
        return F.flatten(F.zip_with(blocks, walked(whole, zero), walked))

    return _bound(values, lambda v: F.when(F.size(v) <= BLOCK, walked(v, zero)).otherwise(blocked(v)))


def _add(x: Column, y: Column) -> Column:
    return x + y


def _spans(kind: Kind) -> Column:
    """All confirmed spans of a kind, by start; offsets are code points, the stop exclusive."""
    matches = F.expr(f"regexp_extract_all(body, r'{kind.pattern}', 0)")
    between = F.expr(f"split(body, r'{kind.pattern}', -1)")
    pairs = F.zip_with(between, matches, lambda piece, match: F.struct(piece.alias("piece"), match.alias("match"), F.coalesce(match.isNotNull() & kind.valid(match) & _apart(kind, piece), F.lit(False)).alias("ok")))

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: (F.length(p["piece"]) + F.coalesce(F.length(p["match"]), F.lit(0))).cast("bigint"))

        def spans(before: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(p["piece"])
                return F.when(p["ok"] & _likely(kind, pairs, p, i), F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(p["match"])).alias("stop")))

            return F.filter(F.transform(pairs, span), lambda x: x.isNotNull())

        return _bound(_before(lengths, _add), spans)

    return F.when(F.col("body").rlike(kind.hint), _bound(pairs, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(kind: Kind, before: Column) -> Column:
    return F.lit(True) if kind.base else ~before.rlike("[A-Za-z0-9.]$")


def _likely(kind: Kind, pairs: Column, own: Column, i: Column) -> Column:
    """Whether the score reaches the least; context words count wherever they stand before the span, over other matches, too.

    A piece and a match have three characters at least, so a few of those before hold the whole context.
    """
    if kind.base or kind.score >= LEAST:
        return F.lit(True)
    n = F.least(i, F.lit(CONTEXT // 3 + 1))
    parts = F.flatten(F.transform(F.slice(pairs, i - n + 1, n), lambda p: F.array(p["piece"], p["match"])))
    near = F.lower(F.right(F.concat(F.array_join(parts, ""), own["piece"]), F.lit(CONTEXT)))
    return F.lit(kind.score) + F.when(near.rlike(kind.words), BOOST).otherwise(0.0) >= LEAST


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, body (the text, empty for null) and found: one array of spans for each kind."""
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("body")).select("doc_id", "body", *[_spans(k).alias(k.name) for k in KINDS])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and all spans.

    Every row is searched by itself, repeated ones and those without doc_id too; a null or empty text has no spans.
    """
    base = [k.name for k in KINDS if k.base]
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return find(docs, text).select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base], F.sha2(listed(F.concat(*map(F.col, base))), 256).alias("base_sha256"), listed(every).alias("spans"))


def _masked() -> Column:
    """The body with each span replaced by its kind; where spans overlap, the first one's kind stands for both."""
    every = F.array_sort(F.flatten(F.array(*[F.transform(k.name, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))) for k in KINDS])))
    blocks = F.expr(f"regexp_extract_all(body, '(?s).{{1,{CHARACTERS}}}', 0)")

    def cut(blocks: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / CHARACTERS).cast("int")
        parts = F.slice(blocks, first + 1, F.floor(stop / CHARACTERS).cast("int") - first + 1)
        return F.substring(F.array_join(parts, ""), (start - first * CHARACTERS + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))

    def built(blocks: Column) -> Column:
        def masked(spans: Column) -> Column:
            def replaced(reach: Column) -> Column:
                one = lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(blocks, F.get(reach, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
                last = F.array_max(F.transform(spans, lambda s: s["stop"]))
                return F.concat(F.array_join(F.transform(spans, one), ""), cut(blocks, last, F.length("body").cast("bigint")))

            # Where all spans before a span stop.
            return _bound(_before(F.transform(spans, lambda s: s["stop"]), lambda x, y: F.greatest(x, y)), replaced)

        return _bound(every, masked)

    return F.when(F.size(every) == 0, F.col("body")).otherwise(_bound(blocks, built))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, with the spans of the text masked; null stays null."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    found = rows.select("row", "body", *[_spans(k).alias(k.name) for k in KINDS])
    return found.select(*[F.when(F.col(f"row.`{c}`").isNotNull(), _masked()).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def _sql_kind(name: str, pattern: str, valid: str) -> str:
    """Spans of one kind in DuckDB: the matches, and the pieces between them, give the offsets."""
    return f"""
SELECT k, '{name}' AS kind, e - length(m) AS s, e FROM (
  SELECT k, m, before, list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(found[1:i], lambda x: length(x)))::BIGINT AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d
  FROM (SELECT k, found, pieces, i, found[i] AS m, pieces[i] AS before FROM (
    SELECT k, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT k, regexp_extract_all(body, '{pattern}') AS found, string_split_regex(body, '{pattern}') AS pieces FROM d WHERE regexp_matches(body, '{pattern}')))))
WHERE {valid}"""


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN substr(d, j, 1)::INT ELSE (2 * substr(d, j, 1)::INT) % 10 + substr(d, j, 1)::INT // 5 END)) % 10 = 0"
_TURNED = "replace(substr(m, 1 + length(regexp_extract(m, '^(?: ?[A-Z0-9]){4}'))) || regexp_extract(m, '^(?: ?[A-Z0-9]){4}'), ' ', '')"
_MOD97 = f"list_reduce(list_transform(range(1, length({_TURNED}) + 1), lambda j: CASE WHEN substr({_TURNED}, j, 1) BETWEEN '0' AND '9' THEN substr({_TURNED}, j, 1)::INT ELSE ascii(substr({_TURNED}, j, 1)) - 55 END), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1"


def _sql_near(kind: Kind) -> str:
    return f"{kind.score} + (CASE WHEN regexp_matches(lower(right(before, {CONTEXT})), '{kind.words}') THEN {BOOST} ELSE 0 END) >= {LEAST} AND NOT regexp_matches(before, '[A-Za-z0-9.]$')"


_PLAIN_CARD = CARD.replace("++", "+")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
f AS ({" UNION ALL ".join([
    _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255"),
    _sql_kind("card", _PLAIN_CARD, f"length(d) BETWEEN 16 AND 19 AND {_LUHN}"),
    _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
    _sql_kind("iban", IBAN, f"{_sql_near(KINDS[4])} AND {_MOD97}"),
    _sql_kind("short_card", _PLAIN_CARD, f"m[1] BETWEEN '3' AND '6' AND length(d) BETWEEN 13 AND 15 AND {_sql_near(KINDS[5])} AND {_LUHN}"),
])}),
o AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'short_card'], kind) AS n, kind || ':' || s || ':' || e AS x FROM f),
a AS (SELECT k, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ("email", "ip", "card", "phone"))}, string_agg(x, ',' ORDER BY n, s) FILTER (n <= 4) AS base, string_agg(x, ',' ORDER BY n, s) AS spans FROM o GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.k = d.k
"""
