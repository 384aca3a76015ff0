"""Personal data by pattern, checksum and context (DataFrame functions only).

Patterns propose spans, checksums (Luhn, mod 97) or value rules confirm them, and words standing just before a span move
its score. Base kinds that pass their rule are always kept; the method adds IBANs, national identity numbers and phone
numbers without a country code, which need a checksum or a context word to reach the score limit.

Spark's regular expression functions give matched texts but no positions; a span starts where the pieces between matches
and the matches before it end, so positions are running sums of two kinds of lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import let

BASE_KINDS = ("email", "ip", "card", "phone")
BLOCK = 64
CONTEXT_CHARS = 40


def _byte_sized() -> str:
    return "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Sum over the digits from the right, every second one doubled (less 9 above 9), is a multiple of ten."""

    def weigh(ds: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(ds, -i, F.lit(1)).cast("int")
            twice = d * 2
            return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.aggregate(F.sequence(F.lit(1), F.length(ds)), F.lit(0), add) % 10 == 0

    return let(digits_of(value), weigh)


def mod97(value: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""

    def rest(v: Column) -> Column:
        turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))

        def add(acc: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

        return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), add) == 1

    return let(F.regexp_replace(value, " ", ""), rest)


#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def iban_of(run: Column) -> Column:
    """The IBAN that a run of letters and digits begins with, null without one. It ends where a word does and passes mod
    97: at its country's length, or else the whole run, or any length (the longest) where the country is not registered."""
    code = F.substring(run, 1, 2)
    want = F.coalesce(*[F.when(code.isin(*codes), F.lit(n)) for n, codes in IBAN_LENGTHS.items()])

    def ends(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))

    def choose(valid: Column) -> Column:
        own = F.filter(valid, lambda v: F.length(F.regexp_replace(v, " ", "")) == want)
        other = F.filter(valid, lambda v: want.isNull() | (v == run))
        return F.coalesce(F.get(own, F.lit(0)), F.try_element_at(other, F.lit(-1)))

    proper = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}$"
    return let(F.filter(let(F.split(run, " "), ends), lambda v: v.rlike(proper) & mod97(v)), choose)


def _digit_count(value: Column, low: int, high: int) -> Column:
    return F.length(digits_of(value)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap test that every text with a match passes. ``score``: before context; kept at ``limit`` and above.
    ``whole``: where the pattern matches the head of a value only and looks ahead at the rest (its group 1), the value that
    both begin with, or null; what follows that value is searched again."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    context: str
    limit: float = 0.5
    whole: Callable[[Column], Column] | None = None


#: The base kinds are the given patterns with possessive loops and look-behinds that leave the same matches but never
#: rescan a run of characters: a match inside a run exists only if one from the run's start (or the last match's end) does.
#: A card's chains of digits are disjoint, so those outside 13 to 19 digits can be left out by the pattern itself.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), 0.9, r"mail|contact|write|schreib|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_byte_sized()}(?:\.{_byte_sized()}){{3}}$"), 0.6, r"\bip\b|address|host|server|adresse"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), luhn, 0.8, r"card|visa|credit|karte|carte|tarjeta|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda v: _digit_count(v, 9, 15), 0.7, r"phone|call|tel|mobile|fax|numero|nummer"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), lambda v: v.isNotNull(), 0.9, r"iban|account|konto|compte|cuenta|bank", whole=iban_of),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), lambda v: ~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0.3, r"\bssn\b|social security|tax id|identity"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", lambda t: t.rlike(r"[0-9][\x20.-][0-9]{4}"), lambda v: _digit_count(v, 10, 10), 0.3, r"phone|call|tel|mobile|fax"),
)


def running(lengths: Column) -> Column:
    """Sums of all items before each item, in blocks: an array of n items costs about n * BLOCK + (n / BLOCK)^2."""

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, x: a + x)

    def with_lengths(ls: Column) -> Column:
        n = F.size(ls)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(ls, b * BLOCK + 1, F.lit(BLOCK))))

        def with_blocks(bs: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: total(F.slice(bs, F.lit(1), b)))
            return let(
                before,
                lambda pre: F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda i: F.get(pre, F.floor(i / BLOCK).cast("int")) + total(F.slice(ls, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
                ),
            )

        return let(blocks, with_blocks)

    return let(lengths, with_lengths)


SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find_kind(text: Column, kind: Kind, keep_low: bool = False) -> Column:
    """Confirmed spans of one kind in order, ``array<struct<kind,start,end,value,score>>``; positions are code points."""

    def located(found: Column, tails: Column | None = None) -> Column:
        def in_pieces(pieces: Column) -> Column:
            lengths = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))

            def spans(starts: Column) -> Column:
                def span(head: Column, i: Column) -> Column:
                    if kind.whole is None:
                        return placed(head, i)
                    return let(kind.whole(F.concat(head, F.get(tails, i))), lambda m: placed(m, i))

                def placed(m: Column, i: Column) -> Column:
                    piece = F.get(pieces, i)
                    start = F.get(starts, i) + F.length(piece)
                    near = F.lower(F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(kind.context)
                    score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(0.4)).otherwise(F.lit(0.0)))
                    return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), score.alias("score"))

                return F.transform(found, span)

            return let(running(lengths), spans)

        return let(F.split(text, kind.pattern, -1), in_pieces)

    def located_whole(found: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)), lambda tails: located(found, tails))

    proposed = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, located_whole(found) if kind.whole else located(found)))
    kept = F.filter(proposed, lambda s: kind.confirm(s["value"]) & (F.lit(keep_low) | (s["score"] >= kind.limit)))
    if kind.whole:  # a head inside a value is none
        none = F.from_json(F.lit("[]"), SPAN)
        kept = F.aggregate(kept, none, lambda a, s: F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) > s["start"], a).otherwise(F.concat(a, F.array(s))))
    return F.coalesce(F.when(kind.hint(text), kept), F.from_json(F.lit("[]"), SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Return ``doc_id`` and ``spans array<struct<kind,start,end,value,score>>``, ordered by kind as listed, then start.

    * null and empty texts have no spans; repeated rows each give a row; an empty table gives no rows.
    * a value that fails its checksum or rule is dropped and nothing inside it is tried again (IBANs: later words are).
    * spans of different kinds may overlap; spans of one kind never do. Very long texts are searched whole.
    * context is the text between the previous match of the kind and this one, the last 40 characters at most.
    * other columns of the input, whatever their names, are not read.
    """
    text = F.col("text")
    found = [find_kind(text, k, keep_low=k.name in BASE_KINDS) for k in kinds]
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.select("doc_id", F.concat(*found).alias("spans"))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _scores(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"], 2).cast("string")), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text and their scores in the same order,
    derived from :func:`find_pii`."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    found = find_pii(docs, id_col, text_col)
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(spans).alias("spans"), _scores(spans).alias("scores"))
