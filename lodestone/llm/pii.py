"""Personal data in whole texts, in DataFrame operations only.

Regular expressions propose spans, validators confirm them (digit counts, octets up to 255, Luhn,
mod-97), and words near a span adjust its score. Four base kinds are kept whatever their context:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     four dot-joined numbers, each at most 255
  card   digits with single spaces or hyphens, 13 to 19 digits passing Luhn
  phone  a plus sign, 9 to 15 digits with spaces, brackets, dots, hyphens
Further kinds are proposed with less certainty and kept if their score reaches THRESHOLD:
  iban      country letters, check digits and as many more characters as the country's numbers
            have (11 to 30 for letters without a known length); mod-97 confirms
  localtel  a national telephone number; needs a word of its context
  idnum     ddd-dd-dddd; needs a word of its context
Matches are leftmost and do not overlap within a kind; one that fails its validator is dropped
without a second try. Positions are code points, the end exclusive.

The patterns are written so that Java's engine runs them in linear time and without recursion
(possessive loops, starts only where a run starts), so very long texts are no problem. Positions
come from one replacement that fences the matches, a split and prefix sums over the parts.

Defined cases: a null text is an empty one; U+0001 in a text is an ordinary character; repeated
rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

FENCE = "\x01"
THRESHOLD = 0.5
#: Characters on either side of a span in which context words count, up to the next proposal of the kind.
NEAR = 40


#: Characters of an account number by country: the registry's, and those in use outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """A country's length ends its number, so a word after a space stays out of it; a number of unknown length ends where one of a known country begins."""
    known = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
    by_length = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items())
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{known})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:{by_length}|{other})(?![A-Za-z0-9])"


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str  # a text without this regular expression has no span of the kind; empty: any text may
    base: bool
    score: float = 1.0  # of a confirmed span without context
    context: str = ""  # words near it that raise the score by `lift`
    lift: float = 0.0


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, r"(?i)\b(?:e-?mail|mail|contact|write)\b", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, r"(?i)\b(?:ip|address|host|server|login)\b", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, 0.8, r"(?i)\b(?:card|visa|credit|debit|cc)\b", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, r"(?i)\b(?:tel|phone|call|fax|mobile)\b", 0.3),
    Kind("iban", iban_pattern(), "", False, 0.8, r"(?i)\b(?:iban|bank|account|konto)\b", 0.2),
    Kind("localtel", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "", False, 0.3, r"(?i)\b(?:tel|phone|call|fax|mobile)\b", 0.4),
    Kind("idnum", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, r"(?i)\b(?:ssn|social|security|insurance)\b", 0.4),
)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    size = F.length(digits)

    def share(i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), size), share), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(compact: Column) -> Column:
    """True if an account number without spaces passes the mod-97 check."""
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$")
    if kind == "card":
        digits = digits_of(match)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix_sums(sizes: Column) -> Column:
    """Exclusive prefix sums of an array of ints, by blocks of about the root of its length: no step over the whole is quadratic."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def running(a: Column, base: Column) -> Column:
        return F.transform(a, lambda _, i: base + total(F.slice(a, F.lit(1), i)))

    def cut(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        starts = F.sequence(F.lit(1), F.size(a), width)
        return F.transform(starts, lambda i: F.slice(a, i, width))

    def whole(blocks: Column) -> Column:
        return bound(F.transform(blocks, total), lambda t: F.flatten(F.zip_with(blocks, running(t, F.lit(0)), running)))

    return bound(sizes, lambda a: bound(cut(a), whole))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def kind_spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind in a text without U+0001."""
    def spans(parts: Column, sums: Column) -> Column:
        def one(i: Column) -> Column:
            match, start = F.get(parts, i), F.get(sums, i)
            score = F.lit(kind.score)
            if kind.context:
                near = F.right(F.get(parts, i - 1), F.lit(NEAR)).rlike(kind.context) | F.left(F.get(parts, i + 1), F.lit(NEAR)).rlike(kind.context)
                score = F.when(near, kind.score + kind.lift).otherwise(kind.score)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"), F.when(confirmed(kind.name, match), score).alias("score"))

        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        return F.filter(F.transform(odd, one), lambda s: s["score"].isNotNull() & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))

    def all_spans(parts: Column) -> Column:
        found = bound(prefix_sums(F.transform(parts, F.char_length)), lambda sums: spans(parts, sums))
        return F.when(F.size(parts) > 2, found).otherwise(none)

    none = F.array().cast(SPANS)
    found = bound(F.split(F.regexp_replace(text, kind.pattern, f"{FENCE}$0{FENCE}"), FENCE, -1), all_spans)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, and for each kind its spans as array<struct<kind, start, end, score>>)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    clean = F.when(F.contains(text, F.lit(FENCE)), F.translate(text, FENCE, "\x02")).otherwise(text)
    chosen = docs.select(F.col(id_column).alias("doc_id"), clean.alias("text"))
    return chosen.select("doc_id", *(kind_spans(F.col("text"), k).alias(k.name) for k in KINDS))


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) with every base kind's unvalidated proposals left alone and confirmed spans replaced by <KIND>."""
    found = find(docs, id_column, text_column).select("doc_id", F.concat(*(F.col(k.name) for k in KINDS)).alias("spans"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(found.select("doc_id", ordered.alias("spans")), "doc_id")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        skip = s["start"] < acc["at"]  # overlaps one of another kind
        return F.struct(F.when(skip, acc["out"]).otherwise(kept).alias("out"), F.when(skip, F.greatest(acc["at"], s["end"])).otherwise(s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.select("doc_id", done.alias("text"))


def _joined(*kinds: str) -> Column:
    texts = (F.transform(F.col(k), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds)
    return F.array_join(F.concat(*texts), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(*base), 256).alias("base_sha256"),
        _joined(*(k.name for k in KINDS)).alias("spans"),
        F.transform(F.concat(*(F.col(k.name) for k in KINDS)), lambda s: F.round(s["score"], 2)).alias("scores"),
    )
