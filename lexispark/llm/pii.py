"""Personal data, in DataFrame expressions only.

Patterns propose spans; Luhn and mod-97 confirm them; words near a span raise
or lower its score. Positions come from the pieces between the matches
(``split``), so a text is scanned a fixed number of times per kind. The
patterns use possessive repeats and start only where a run starts: they match
what their plain forms match, in linear time and constant stack. Of an IBAN
the pattern proposes the head only; where it ends is for its check digits to
say, among the places where a group ends. An IBAN that starts inside another
is part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_MAIL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, its score before context, and the words that speak for it."""

    name: str
    pattern: str
    base: float
    words: str
    hint: str  # a cheap pattern without which the kind cannot occur


#: In the order in which spans at one start are listed.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.8, r"\bip\b|host|server|address", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.8, "card|visa|credit|payment", "[0-9]{2}|[0-9][ -][0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, "phone|tel|call|mobile|fax", r"\+[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?+[A-Z0-9]){11})", 0.6, "iban|bank|account",
         "[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3,
         r"\bssn\b|social security|tax id", "[0-9]-[0-9]"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: A span counts from this score on; a context word adds, a word of these lowers the score of kinds beyond the base.
THRESHOLD, NEARBY, BONUS = 0.5, 40, 0.3
AGAINST = "order|invoice|serial|version|build"
#: What may follow an IBAN's head: up to 30 characters, a space before each.
_IBAN_REST, _IBAN_REACH = r"^(?:\x20?+[A-Z0-9]){11,30}+", 60
#: Heads that can lie in the longest IBAN.
_IBAN_HEADS = (4 + _IBAN_REACH) // 4
#: Registered lengths, without spaces; they only choose among several prefixes that pass mod-97.
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30")

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn: from the right, each second digit is doubled, less 9 from 10 on."""
    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.element_at(
        F.when((F.length(digits) - i) % 2 == 1, F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]))
        .otherwise(F.array(*[F.lit(x) for x in range(10)])), F.substring(digits, i, 1).cast("int") + 1))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's rearranged digits leave 1 modulo 97; A counts as 10."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: F.when(
        F.substring(turned, i, 1).between("0", "9"), (acc * 10 + F.substring(turned, i, 1).cast("int")) % 97).otherwise(
        (acc * 100 + F.ascii(F.substring(turned, i, 1)) - 55) % 97)) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _iban(head: Column, after: Column) -> Column:
    """The IBAN that ``head`` begins, null if none: of the prefixes that end with a group and pass mod-97 the one of the
    country's length, else the longest."""
    run = F.concat(head, F.regexp_extract(after, _IBAN_REST, 0))
    past = F.concat(head, after)

    def plain(p: Column) -> Column:
        return F.regexp_replace(F.substring(run, F.lit(1), p), " ", "")

    ends = F.filter(F.sequence(F.lit(15), F.greatest(F.lit(15), F.length(run))), lambda p: (
        F.substring(past, p, F.lit(2)).rlike(r"^[A-Z0-9](?![A-Za-z0-9])") & F.length(plain(p)).between(15, 34)
        & mod97(plain(p))))
    best = F.array_max(F.transform(ends, lambda p: F.struct(
        F.contains(F.lit(_IBAN_LENGTHS), F.concat(F.substring(head, 1, 2), F.length(plain(p)).cast("string"))).alias("usual"),
        p.alias("p"))))
    return F.substring(run, F.lit(1), best["p"])


_EMPTY = "array<struct<start:int,end:int,kind:int,score:double>>"
#: Items of a scan's chunk, and code points of a text's blocks.
_CHUNK, _BLOCK = 64, 1024


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value made once: inside lambdas a variable costs nothing, an expression is made at each use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _before(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """For each of the bound, not empty ``items`` the merged values of all before it, from 0.

    Chunks are merged first, then their merges, so an item costs its chunk
    and not all before it. (A list in an aggregate's state would be copied at
    each step.)
    """
    n, zero = F.size(items), F.lit(0)

    def over(first: Column, last: Column, start: Column, at: Callable[[Column], Column]) -> Column:
        return F.when(last < first, start).otherwise(F.aggregate(F.sequence(first, last), start, lambda s, j: merge(s, at(j))))

    def chunk(i: Column) -> Column:
        return F.floor((i - 1) / _CHUNK).cast("int")

    def item(j: Column) -> Column:
        return value(F.element_at(items, j))

    whole = F.transform(F.sequence(zero, chunk(n)), lambda k: over(k * _CHUNK + 1, F.least(n, (k + 1) * _CHUNK), zero, item))
    return _bound(whole, lambda t: _bound(
        F.transform(F.sequence(F.lit(1), F.size(t)), lambda k: over(F.lit(1), k - 1, zero, lambda j: F.element_at(t, j))),
        lambda heads: F.transform(F.sequence(F.lit(1), n), lambda i: over(
            chunk(i) * _CHUNK + 1, i - 1, F.element_at(heads, chunk(i) + 1), item))))


def _blocks(text: Column) -> Column:
    """A text in blocks of ``_BLOCK`` code points, so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in blocks."""
    first, last = (F.floor(x / _BLOCK).cast("int") for x in (start, end))
    head = F.substring(F.coalesce(F.try_element_at(blocks, first + 1), F.lit("")), start % _BLOCK + 1, F.least(end - start, F.lit(_BLOCK)))
    rest = F.concat(F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                    F.substring(F.coalesce(F.try_element_at(blocks, last + 1), F.lit("")), F.lit(1), end % _BLOCK))
    return F.when(first == last, head).otherwise(F.concat(head, rest))


def _spans(text: Column, order: int) -> Column:
    """The accepted spans of one kind; start and end in code points, end exclusive."""
    k = KINDS[order]
    reach = NEARBY + (_IBAN_REACH if k.name == "iban" else 0)
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    # what follows each match, whatever matches there
    after = F.regexp_extract_all(text, F.lit(rf"(?:{k.pattern})(?=((?s:.{{0,{reach}}})))"), F.lit(1))
    between = F.slice(F.split(text, k.pattern, -1), F.lit(1), F.size(found))
    rows = F.transform(F.arrays_zip(between.alias("gap"), found.alias("m"), after.alias("after")), lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), (F.length(x["gap"]) + F.length(x["m"])).alias("step"), x["m"].alias("m"), x["after"].alias("after"),
        (_iban(x["m"], x["after"]) if k.name == "iban" else F.when(_confirmed(k.name, x["m"]), x["m"])).alias("whole")))

    def positioned(r: Column, blocks: Column) -> Column:
        sums = _before(r, lambda x: x["step"], lambda a, b: a + b)
        return F.filter(F.zip_with(r, sums, lambda x, at: F.when(x["whole"].isNotNull(), F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["whole"])).alias("end"),
            _cut(blocks, F.greatest(F.lit(0), at + x["gap"] - NEARBY), at + x["gap"]).alias("before"),
            F.substring(x["after"], F.length(x["whole"]) - F.length(x["m"]) + 1, F.lit(NEARBY)).alias("after")))),
            lambda x: x.isNotNull())

    placed = _bound(rows, lambda r: _bound(_blocks(text), lambda b: positioned(r, b)))
    if k.name == "iban":  # one that starts inside another is part of it; heads are four apart or more
        def apart(spans: Column) -> Column:
            return F.filter(spans, lambda x, i: ~F.exists(F.sequence(F.greatest(F.lit(0), i - _IBAN_HEADS), i), lambda j: (
                (j < i) & (F.get(spans, j)["end"] > x["start"]))))
        placed = _bound(placed, apart)

    def scored(x: Column) -> Column:
        near = F.lower(F.concat_ws(" ", x["before"], x["after"]))
        score = F.lit(k.base) + F.when(near.rlike(k.words), BONUS).otherwise(0.0)
        if k.name not in BASE_KINDS:
            score = score - F.when(near.rlike(AGAINST), BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"),
                        F.lit(order).alias("kind"), F.least(F.lit(1.0), score).alias("score"))

    spans = F.filter(F.transform(placed, scored), lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(k.hint) & (F.size(found) > 0), spans).otherwise(F.array().cast(_EMPTY))


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with ``out_col``: array<struct<start, end, kind, score>> by start, then kind (its place in KINDS).

    Matches of one kind do not overlap; spans of different kinds may. A base
    kind's span always stays: its score without context is above the
    threshold and nothing lowers it. Null and empty texts have no spans. The
    operator is row-local, so ties, repeated rows, an empty table and other
    columns need no rule; a column named as ``out_col`` is replaced.
    """
    text = text_of(text_col)
    return df.withColumn(out_col, F.array_sort(F.flatten(F.array(*[_spans(text, i) for i in range(len(KINDS))])),
                                               lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                                               .otherwise(a["kind"] - b["kind"])))


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    if kinds is not None:
        wanted = [i for i, k in enumerate(KINDS) if k.name in kinds]
        spans = F.filter(spans, lambda s: s["kind"].isin(wanted))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    at = [k.name for k in KINDS].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == at)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])
    def parts(all_spans: Column, blocks: Column) -> Column:
        return _bound(_before(all_spans, lambda s: s["end"], F.greatest), lambda done: F.concat(
            F.array_join(F.zip_with(all_spans, done, lambda s, at: F.when(s["start"] >= at, F.concat(
                _cut(blocks, at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")), ""),
            F.substring(text, F.greatest(F.element_at(done, -1), F.element_at(all_spans, -1)["end"]) + 1, F.length(text))))

    return F.when(F.size(spans) > 0, _bound(spans, lambda s: _bound(_blocks(text), lambda b: parts(s, b)))).otherwise(text)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data in ``text_col`` masked; null stays null, all other columns as they are, whatever their names."""
    out_col = "__pii"
    while out_col in df.columns:
        out_col += "_"
    found = find_pii(df, text_col, out_col)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col(out_col))).drop(out_col)
