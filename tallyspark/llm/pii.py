"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

Each kind's expression marks its matches in the text; cutting the marked text
gives the matches with their code point positions. Validators (Luhn, mod 97,
number ranges, digit counts) then confirm them, and words nearby adjust a score:
kinds that are trusted by themselves keep any score, the others need the context
to pass ``threshold``.

The expressions are written with possessive quantifiers and begin either where
the previous match ended or where no character of their first class stands
before, which finds the same leftmost matches in linear time. Positions are running sums over
the cut pieces, built in slices, so that a text's time grows with its length and not
with the square of its matches.

Defined results: a null or empty text has no spans; repeated rows are judged one
by one; an empty table gives an empty table; a column named as ``into`` is replaced,
and of the input's other columns only ``text`` changes, where masking is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, PLAIN = "\x01", "\x02"
#: Elements that a scan adds to one array before it begins the next.
SLICE = 64
#: Code points of a text's parts where pieces of it are read by position.
PART = 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]  # test of the matched string
    hint: str  # expression for context words
    base: float  # score without context
    trusted: bool  # kept whatever its score


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _slices(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / SLICE), F.lit(0)).cast("int")), lambda k: F.slice(values, k * SLICE + 1, SLICE))


def _scan(values: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Walks over ``values`` with a number that starts at 0; ``step`` gives the next number and what to add (array<kind>)."""
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        at, more = step(a["at"], x)
        return F.struct(at.alias("at"), F.concat(a["out"], more).alias("out"))

    def slice_of(a: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), one, lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], F.array(w["out"])).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(_slices(values), zero, slice_of)["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda s: F.length(_digits(s)).between(low, high)


def luhn(s: Column) -> Column:
    """The Luhn sum of the digits of ``s`` is a multiple of ten."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    values = F.transform(_characters(F.reverse(_digits(s))), value)
    return F.aggregate(values, F.lit(0), lambda t, v: t + v) % 10 == 0


def mod97(s: Column) -> Column:
    """The account number ``s`` leaves 1 modulo 97 after its first four characters move to the end."""
    plain = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(t: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (t * 100 + code - 55) % 97).otherwise((t * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(_characters(moved), F.lit(0), step) == 1)


def ip_parts(s: Column) -> Column:
    stripped = F.transform(F.split(s, "[.]"), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(stripped, lambda x: (F.length(x) <= 3) & (F.when(F.length(x) == 0, 0).when(F.length(x) <= 3, x.cast("int")).otherwise(999) <= 255))


def any_match(s: Column) -> Column:
    return F.lit(True)


#: Base kinds, in the order that ties follow.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", any_match, r"mail|contact|write|reply", 0.9, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ip_parts, r"\bip\b|server|host|address|login", 0.6, True),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", lambda s: _digit_count(12, 19)(s) & luhn(s), r"card|credit|visa|pay|debit|cvv", 0.7, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _digit_count(9, 15), r"phone|call|tel|mobile|fax|ring", 0.8, True),
]
#: Kinds that the method adds.
ADDED = [
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, r"iban|bank|account|transfer|swift", 0.9, False),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", any_match, r"phone|call|tel|mobile|fax|ring", 0.3, False),
]


def _matches(text: Column, kind: Kind, window: int) -> Column:
    """array<struct<kind, start, end, score>> of an expression's valid matches."""
    marked = F.regexp_replace(F.translate(text, MARK, PLAIN), kind.pattern, f"{MARK}$0{MARK}")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    # no match is shorter than five characters, so these pieces hold the window
    reach = 2 * -(-window // 5)

    def spans(pieces: Column) -> Column:  # every second piece is a match
        every = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return _let(F.filter(every, lambda k: kind.valid(F.get(pieces, k))), lambda good: F.when(F.size(good) > 0, placed(pieces, good)).otherwise(none))

    def placed(pieces: Column, good: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p))
        heads, tails = F.transform(pieces, lambda p: F.left(p, F.lit(window))), F.transform(pieces, lambda p: F.right(p, F.lit(window)))
        starts = _scan(sizes, "int", lambda at, n: (at + n, F.array(at)))
        return _let(F.struct(starts.alias("starts"), heads.alias("heads"), tails.alias("tails")), lambda c: F.transform(good, lambda k: span(pieces, c, k)))

    def span(pieces: Column, c: Column, k: Column) -> Column:
        before = F.right(F.array_join(F.slice(c["tails"], F.greatest(k - reach, F.lit(0)) + 1, F.least(k, F.lit(reach))), ""), F.lit(window))
        after = F.left(F.array_join(F.slice(c["heads"], k + 2, reach), ""), F.lit(window))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(kind.hint)
        start = F.get(c["starts"], k)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(F.get(pieces, k))).alias("end"),
            F.when(near, F.lit(round(min(1.0, kind.base + 0.3), 1))).otherwise(F.lit(kind.base)).alias("score"),
        )

    return _let(F.split(marked, MARK), spans)


def personal_data(documents: DataFrame, text_col: str = "text", window: int = 40, threshold: float = 0.5, into: str = "spans") -> DataFrame:
    """Adds ``into``: array<struct<kind, start, end, score>> sorted by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = None
    for order, kind in enumerate([*BASE, *ADDED]):
        scored = _matches(text, kind, window)
        if not kind.trusted:
            scored = F.filter(scored, lambda x: x["score"] >= threshold)
        keyed = F.transform(scored, _keyed(order))
        none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:double>>")
        # cheap tests keep most texts from the expression
        keyed = F.when(_possible(text, kind), keyed).otherwise(none)
        every = keyed if every is None else F.concat(every, keyed)
    out = F.transform(F.array_sort(every), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return documents.withColumn(into, out)


def _keyed(order: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score"))


def _possible(text: Column, kind: Kind) -> Column:
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    return needs.get(kind.name, text.rlike(r"[0-9][0-9 .-]"))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(kinds))


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = spans if kinds is None else of_kinds(spans, kinds)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of
    overlapping spans the first in order stands."""
    standing = _scan(spans, "struct<kind:string,start:int,end:int,from:int>", lambda at, x: (F.greatest(at, F.when(x["start"] >= at, x["end"]).otherwise(at)), F.when(x["start"] >= at, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), at.alias("from")))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,from:int>>"))))

    def piece(parts: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / PART).cast("int")
        several = F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1)
        return F.substring(F.array_join(several, ""), begin - first * PART + 1, end - begin)

    def done(c: Column) -> Column:
        changed = F.transform(c["standing"], lambda x: F.concat(piece(c["parts"], x["from"], x["start"]), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(changed, ""), piece(c["parts"], F.element_at(c["standing"], -1)["end"], F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), 0)
    return F.when(F.size(spans) > 0, _let(F.struct(standing.alias("standing"), parts.alias("parts")), done)).otherwise(text)


def masked_documents(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with their personal data masked; all columns and rows stay."""
    spans = next(c for c in ("spans", "_spans", "__spans") if c not in {x.lower() for x in documents.columns})
    found = personal_data(documents, text_col, into=spans, **options)
    return found.select(*[masked(F.col(c), F.col(spans)).alias(c) if c == text_col else F.col(c) for c in documents.columns])
