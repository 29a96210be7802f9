"""Personal data in whole texts: format rules, and boosted trees over high-recall candidates.

Two layers, both of built-in expressions only:

* The base spans are four fixed patterns with validity tests (Luhn, parts, numbers of digits).
* Generators propose further, overlapping candidates: numbers from the start of each group of digits to the end of each
  group, addresses that may be spelled out, from each word, and hosts: four numbers with spelled-out or spaced dots, and
  addresses of eight groups. So a number is a candidate of its own whatever numbers stand beside it. Trees boosted on
  format and context features score each candidate that touches no base span; a threshold for each kind, calibrated on a
  held-out half for a wanted precision, selects those that are redacted beside the base spans. Of selected ones that
  overlap, of whatever kinds, the one furthest above its threshold stays, then one in a usual grouping, then the longer.

The trees are trained here. Labels come from two sides: of about SAMPLE of the given documents (by a hash of id and text,
each text once), the base spans, rewritten into forms that the base patterns don't know and left in their own context,
are positive, and other candidates in these documents are negative unless they show a mark of a form (SUSPECT: nobody
knows what those are); and a rule-made table of TRAINING_ROWS rows holds
forms that documents may lack, and hard negatives (wrong check digits, dates, two neighbours taken for one). One half of
the documents and of the rows is held out. The feature vectors are made by the same expressions and grouped by Spark, so
that only distinct vectors with their counts reach the driver. The fitted trees become one CASE expression; precision and
recall on the held-out half stand beside them.

Null texts count as empty; an empty text has no spans. Repeated rows are scanned each for itself. Other columns than
the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns. Possessive repeats and the look-behind change no match; they keep Java's matcher from recursion and from quadratic retries.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Generators of candidates. Each looks ahead for a candidate (group 1) and takes its first character only, so that the next may overlap it.
_BETWEEN = r"[\x20().-]{0,2}+"
#: From the start of each group of digits up to LONGEST digits, and the letter or digit right behind.
SHORTEST, LONGEST = 7, 25
#: Matches that are located together.
BLOCK = 128
#: Up to so many spans of a text are compared one by one; more are searched by halves, and settled by clusters, with the same results.
FEW = 32
NUMBER = rf"(?<![0-9A-Za-z])(?=([+(]?[0-9](?:{_BETWEEN}[0-9]){{{SHORTEST - 1},{LONGEST - 1}}}+[0-9A-Za-z]?))[+(0-9]"
#: What a text must match for numbers to be looked for.
NUMBER_NEEDS = rf"[0-9](?:{_BETWEEN}[0-9]){{{SHORTEST - 1}}}"
_AT, _DOT = r"\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20", r"\x20?[\[(](?:(?i:dot)|\.)[\])]\x20?|\x20(?i:dot)\x20"
ADDRESS = rf"(?<![{_LOCAL}])(?=([{_LOCAL}]{{1,64}}+(?:@|{_AT})[A-Za-z0-9-]{{1,63}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}+){{1,5}}+))[{_LOCAL}]"
ADDRESS_NEEDS = rf"@|{_AT}"
_SPACED = r"\x20\.\x20?|\.\x20"
_GROUP = "[0-9A-Fa-f]{1,4}"
HOST = rf"(?<![0-9A-Za-z:.])(?=([0-9]{{1,3}}(?:(?:\.|{_DOT}|{_SPACED})[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])|(?:{_GROUP}:){{7}}{_GROUP}(?![0-9A-Za-z:])|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}(?![0-9A-Za-z:])))[0-9A-Fa-f]"
HOST_NEEDS = rf"[0-9](?:{_DOT}|{_SPACED})[0-9]|[0-9A-Fa-f]::[0-9A-Fa-f]|(?:{_GROUP}:){{7}}"

CUE_PHONE = r"(?i)(?:tel|phone|call|mobile|fax|ruf|appel|llam)[a-z]*[\x20:.]{0,3}$"
CUE_CARD = r"(?i)(?:card|visa|karte|carte|tarjeta|credit|kredit)[a-z]*[\x20:.]{0,3}$"
CUE_MAIL = r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)[a-z]*[\x20:.]{0,3}$"

CUE_HOST = r"(?i)(?:host|server|ip|address|node|gateway|login|from|serveur|servidor)[a-z]*[\x20:.]{0,3}$"

#: Rule-made rows, and about so many documents, that the trees are trained and calibrated on.
TRAINING_ROWS, SAMPLE = 6000, 20_000


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    total = F.aggregate(
        F.split(F.reverse(d), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda a, c: F.struct(
            (a["i"] + F.when(c == "", 0).otherwise(1)).alias("i"),
            (a["sum"] + F.when(c == "", 0).otherwise(F.when(a["i"] % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(c >= "5", 9).otherwise(0)))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, t: Column) -> Column:
    n = F.length(digits(t))
    return {
        "email": F.lit(True),
        "ip": t.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": n.between(16, 19) & luhn(digits(t)),
        "phone": n.between(8, 15),
    }[kind]


_SPANS = "array<struct<s:int,e:int,t:string,l:string>>"


def _cut(text: Column, pattern: str, there: Column, group: int) -> tuple[Column, Column]:
    """The stretches between the matches, and the matches (what their group holds)."""
    gaps = F.when(there, F.split(text, pattern, -1)).otherwise(F.array(text))
    return gaps, F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _bound(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.transform(F.array(x), use)[0]


def _blocks(z: Column) -> Column:
    """An array that isn't empty, in arrays of BLOCK: an aggregate copies what it gathers at each step, so that it should gather little."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, BLOCK))


def _tops(ends: Column) -> Column:
    """For each number of an array that isn't empty, the largest before it; 0 for the first."""

    def block(b: Column, at: Column) -> Column:
        none = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(b, none, lambda a, x: F.struct(F.greatest(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def all_of(bs: Column) -> Column:
        begins = F.aggregate(F.slice(bs, 1, F.size(bs) - 1), F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(b)))))
        return F.flatten(F.zip_with(bs, begins, block))

    return _bound(_blocks(ends), all_of)


def _located(gaps: Column, hits: Column, group: int) -> Column:
    """Matches with start and end in code points, and up to 24 characters before them. Matches by group 1 take one character of the text."""
    width = lambda h: F.length(h) if group == 0 else F.lit(1)
    after = lambda at, x: at + F.length(x["g"]) + F.coalesce(width(x["h"]), F.lit(0))
    here = lambda at, x: F.struct((at + F.length(x["g"])).alias("s"), (at + F.length(x["g"]) + F.length(x["h"])).alias("e"), x["h"].alias("t"), F.right(x["g"], F.lit(24)).alias("l"))
    blocks = _bound(F.arrays_zip(gaps.alias("g"), hits.alias("h")), _blocks)

    def block(b: Column, at: Column) -> Column:
        none = F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(b, none, lambda a, x: F.struct(after(a["at"], x).alias("at"), F.when(x["h"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(here(a["at"], x)))).alias("out")), lambda a: a["out"])

    def all_of(bs: Column) -> Column:
        sizes = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), after))
        begins = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(bs, begins, block))

    return F.when(F.size(hits) == 0, F.array().cast(_SPANS)).otherwise(_bound(blocks, all_of))


def _with_spans(df: DataFrame, wanted: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """Adds for each name (pattern, when to try it, group) an array of located matches; the text stays in column _text."""
    cuts = {k: _cut(F.col("_text"), *v) for k, v in wanted.items()}
    df = df.withColumns({f"_g_{k}": g for k, (g, _) in cuts.items()} | {f"_h_{k}": h for k, (_, h) in cuts.items()})
    df = df.withColumns({f"_s_{k}": _located(F.col(f"_g_{k}"), F.col(f"_h_{k}"), group) for k, (_, _, group) in wanted.items()})
    return df.drop(*[f"_{x}_{k}" for k in wanted for x in "gh"])


# -- the model -------------------------------------------------------------------------------------------------------


def features(t: Column, left: Column) -> dict[str, Column]:
    """Format and context of a candidate; each a boolean that is never null."""
    n = F.length(digits(t))
    return {
        "plus": t.startswith("+"),
        "digits_10_11": n.between(10, 11),
        "digits_8_15": n.between(8, 15),
        "digits_16_19": n.between(16, 19),
        "luhn": n.between(16, 19) & luhn(digits(t)),
        "groups_334": t.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"),
        "groups_4444": t.rlike(r"^[0-9]{4}(?:[\x20.-]{1,2}[0-9]{4}){3}$"),
        "paren": t.contains("("),
        "date": t.rlike(r"^(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]"),
        "dots_only": t.rlike(r"^[0-9]+(?:\.[0-9]+)+$"),
        "plain": t.rlike(r"^[0-9]+$"),
        "cue_phone": left.rlike(CUE_PHONE),
        "cue_card": left.rlike(CUE_CARD),
        "cue_mail": left.rlike(CUE_MAIL),
        "bracket_at": t.rlike(r"(?i)[\[(]at[\])]"),
        "spelled_dot": t.rlike(r"(?i)(?:\x20dot\x20|[\[(]dot[\])])"),
        "known_end": t.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|eu|uk)$"),
        "at_sign": t.contains("@"),
        "in_range": t.rlike(rf"^{_PART}(?:[^0-9]+{_PART}){{3}}$"),
        "bracket_dot": t.rlike(r"[\[(](?i:dot|\.)[\])]"),
        "spaced_dot": t.rlike(_SPACED),
        "colons": t.contains(":"),
        "small_parts": t.rlike(r"^[0-9](?:[^0-9]+[0-9]){3}$"),
        "some_digit": t.rlike("[0-9]"),
        "cue_host": left.rlike(CUE_HOST),
        "pairs": t.rlike(r"^[0-9]{2}(?:[\x20.-]{1,2}[0-9]{2}){3,}$"),
        "thousands": t.rlike(r"^[0-9]{1,3}(?:[\x20.][0-9]{3}){2,}$"),
        "short_groups": t.rlike(r"(?:^|[^0-9])[0-9]{1,2}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{1,2}(?:[^0-9]|$)"),
    }


FEATURES = ("plus", "digits_10_11", "digits_8_15", "digits_16_19", "luhn", "groups_334", "groups_4444", "paren", "date", "dots_only", "plain", "cue_phone", "cue_card", "cue_mail", "bracket_at", "spelled_dot", "known_end", "at_sign", "in_range", "bracket_dot", "spaced_dot", "colons", "small_parts", "some_digit", "cue_host", "pairs", "thousands", "short_groups")
#: Marks of a form: a candidate of a document that shows one gets no label.
SUSPECT = ("luhn", "groups_334", "groups_4444", "cue_phone", "cue_card", "cue_mail", "cue_host", "bracket_at", "spelled_dot", "bracket_dot", "colons")
MODELS = {"email": "address", "ip": "host", "card": "number", "phone": "number"}


def training_table(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled candidates by rule: columns source (number or address), t, l, kind (null: not personal) and held_out."""
    i = F.col("id")
    some = lambda n, salt: F.lpad((F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(10**n))).cast("string"), n, "0")
    area = F.concat((F.pmod(F.xxhash64(i, F.lit(3)), F.lit(8)) + 2).cast("string"), some(2, 4))
    body = F.concat(F.lit("4"), some(14, 5))
    card = F.concat(body, F.filter(F.split(F.lit("0123456789"), ""), lambda c: (c != "") & luhn(F.concat(body, c)))[0])
    wrong = F.concat(body, F.filter(F.split(F.lit("0123456789"), ""), lambda c: (c != "") & ~luhn(F.concat(body, c)))[0])
    four = lambda c, by: F.concat_ws(by, *[c.substr(k, 4) for k in (1, 5, 9, 13)])
    name = F.concat(F.lit("n"), some(3, 6))
    octet = lambda salt: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(256)).cast("string")
    prose = F.element_at(F.array(*map(F.lit, ("of the ", "the number ", "in ", "order ", "since "))), (F.pmod(F.xxhash64(i, F.lit(7)), F.lit(5)) + 1).cast("int"))
    made = [
        ("number", F.concat(F.lit("("), area, F.lit(") "), some(3, 8), F.lit("-"), some(4, 9)), F.lit("call "), "phone"),
        ("number", F.concat(F.lit("("), area, F.lit(") "), some(3, 8), F.lit("-"), some(4, 9)), prose, "phone"),
        ("number", F.concat_ws("-", area, some(3, 8), some(4, 9)), F.lit("phone: "), "phone"),
        ("number", F.concat_ws(".", area, some(3, 8), some(4, 9)), F.lit("tel. "), "phone"),
        ("number", F.concat(area, some(7, 8)), F.lit("mobile "), "phone"),
        ("number", F.concat(F.lit("20"), some(2, 8), F.lit("-0"), (F.pmod(i, F.lit(9)) + 1).cast("string"), F.lit("-1"), some(1, 9)), prose, None),
        ("number", F.concat(area, some(7, 8)), prose, None),
        ("number", F.concat_ws(".", area, some(3, 8), some(4, 9)), prose, None),
        ("number", some(8, 8), prose, None),
        ("number", four(card, "."), prose, "card"),
        ("number", four(card, "  "), F.lit("card "), "card"),
        ("number", card, F.lit("visa "), "card"),
        ("number", wrong, prose, None),
        ("number", four(wrong, "-"), F.lit("card "), None),
        ("number", F.concat(F.lit("+1 ("), area, F.lit(") "), some(3, 8), F.lit("-"), some(4, 9)), prose, "phone"),
        ("number", F.concat_ws(" ", F.concat(F.lit("0"), some(3, 8)), some(3, 9), some(5, 10)), F.lit("tel. "), "phone"),
        # Groups of digits that are no number of anybody: pairs, thousands, codes and times; and pairs that a word calls a number.
        ("number", F.concat_ws(" ", *[some(2, k) for k in range(3, 9)]), prose, None),
        ("number", F.concat_ws(" ", *[some(2, k) for k in range(3, 8)]), prose, None),
        ("number", F.concat_ws("-", *[some(2, k) for k in range(3, 7)]), prose, None),
        ("number", F.concat_ws(" ", *[some(2, k) for k in range(3, 8)]), F.lit("tel. "), "phone"),
        ("number", F.concat_ws(" ", some(2, 3), some(3, 4), some(3, 5), some(3, 6)), prose, None),
        ("number", F.concat_ws(" ", some(1, 3), some(2, 4), some(1, 5), some(2, 6), some(2, 7)), prose, None),
        ("number", four(wrong, " "), prose, None),
        # Two neighbours taken for one.
        ("number", F.concat(F.lit("("), area, F.lit(") "), some(3, 8), F.lit("-"), some(4, 9), F.lit(" ("), area, F.lit(") "), some(3, 10), F.lit("-"), some(4, 11)), F.lit("call "), None),
        ("number", F.concat_ws(" ", F.concat_ws("-", area, some(3, 8), some(4, 9)), F.concat_ws("-", area, some(3, 10), some(4, 11))), F.lit("phone: "), None),
        ("number", F.concat(area, some(7, 8), F.lit(" "), area, some(7, 10)), F.lit("mobile "), None),
        ("number", F.concat(F.lit("("), area, F.lit(") "), some(3, 8), F.lit("-"), some(4, 9), F.lit(" "), some(6, 10)), prose, None),
        ("address", F.concat(name, F.lit(" [at] mail"), some(1, 8), F.lit(".com")), prose, "email"),
        ("address", F.concat(name, F.lit("(at)host(dot)org")), F.lit("contact "), "email"),
        ("address", F.concat(name, F.lit(" at mail"), some(1, 8), F.lit(" dot com")), prose, "email"),
        ("address", F.concat(name, F.lit(" at noon.then")), prose, None),
        ("address", F.concat(name, F.lit(" at the.end")), prose, None),
        ("address", F.concat(name, F.lit(" at example.com")), F.lit("e-mail "), "email"),
        ("address", F.concat(name, F.lit("@mail[dot]com")), prose, "email"),
        ("address", F.concat(F.upper(name), F.lit(" AT MAIL DOT COM")), prose, "email"),
        ("address", F.concat(name, F.lit(" at the.And")), prose, None),
        *[("host", F.concat_ws(dot, octet(3), octet(4), octet(5), octet(6)), left, "ip") for dot, left in (("[.]", prose), (" dot ", prose), ("(dot)", F.lit("server ")), (" . ", F.lit("ip ")))],
        ("host", F.concat_ws("[.]", octet(3), octet(4), some(1, 5), F.lit("999")), prose, None),
        ("host", F.concat_ws(". ", some(1, 3), some(1, 4), some(1, 5), some(1, 6)), prose, None),
        ("host", F.concat_ws(" . ", some(3, 3), some(3, 4), F.lit("777"), some(3, 6)), prose, None),
        ("host", F.concat_ws(". ", some(2, 3), some(1, 4), some(2, 5), some(1, 6)), prose, None),
        ("host", F.concat_ws(":", *[F.substring(F.md5(F.concat(i.cast("string"), F.lit(str(k)))), 1, 4) for k in range(8)]), prose, "ip"),
        ("host", F.concat(F.lit("fe80::"), F.substring(F.md5(i.cast("string")), 1, 4), F.lit(":1")), prose, "ip"),
        ("host", F.lit("bad::cafe"), prose, None),
    ]
    which = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(len(made)))
    pick = lambda f: F.coalesce(*[F.when(which == k, f(m)) for k, m in enumerate(made)])
    return spark.range(rows).select(pick(lambda m: F.lit(m[0])).alias("source"), pick(lambda m: m[1]).alias("t"), pick(lambda m: m[2]).alias("l"), pick(lambda m: F.lit(m[3])).alias("kind"), (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(2)) == 1).alias("held_out"))


def labelled(docs: DataFrame) -> DataFrame:
    """Labelled candidates of documents (_id, _text), in the columns of training_table()."""
    df = _spanned(docs)
    held = (F.pmod(F.xxhash64(F.lit(2), "_id", F.length("_text")), F.lit(2)) == 1).alias("held_out")
    named = lambda k: F.transform(_kept(k), lambda x: F.struct(F.lit(k).alias("kind"), x["t"].alias("t"), x["l"].alias("l")))
    each = df.select(held, F.explode(F.concat(*map(named, KINDS))).alias("x"))
    t, l, kind = F.col("x.t"), F.col("x.l"), F.col("x.kind")  # noqa: E741
    way = F.pmod(F.xxhash64(t, l), F.lit(4))
    choose = lambda *forms: F.coalesce(*[F.when(way == k, f) for k, f in enumerate(forms)])
    domain = F.substring_index(t, "@", -1)
    spelled = lambda at, dot: F.concat(F.substring_index(t, "@", 1), F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
    national = F.regexp_replace(t, r"^\+[0-9]{1,3}?(?![0-9])[\x20.-]*", "")
    plain = digits(national)
    grouped = lambda by: F.concat_ws(by, plain.substr(1, 3), plain.substr(4, 3), plain.substr(7, 9))
    four = lambda by: F.concat_ws(by, *[digits(t).substr(k, 4) for k in (1, 5, 9, 13)])
    dotted = lambda by: F.replace(t, F.lit("."), F.lit(by))
    cue = F.when((kind == "phone") & (way == 3), F.concat(l, F.lit(" tel. "))).otherwise(l)
    form = F.when(kind == "email", choose(spelled(" [at] ", " [dot] "), spelled("(at)", "(dot)"), spelled(" at ", " dot "), spelled("@", "[dot]"))).when(kind == "ip", choose(dotted("[.]"), dotted(" dot "), dotted("(.)"), dotted("[dot]")))
    form = form.when(kind == "card", choose(four("."), four("  "), four(". "), four("."))).when(F.length(plain).between(9, 11), choose(national, grouped("-"), grouped("."), plain))
    source = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    good = each.select(source[kind].alias("source"), form.alias("t"), F.right(cue, F.lit(24)).alias("l"), kind.alias("kind"), "held_out").filter("t is not null")
    free = F.filter(_candidates(), lambda c: ~_touches(c))
    bad = df.select(held, F.explode(free).alias("x")).select(F.col("x.source"), F.col("x.t"), F.col("x.l"), F.lit(None).cast("string").alias("kind"), "held_out")
    looks = features(F.col("t"), F.col("l"))
    bad = bad.filter(~reduce(or_, [looks[f] for f in SUSPECT]))
    return good.unionByName(bad)


def _sampled(docs: DataFrame) -> DataFrame:
    """_id and _text of about SAMPLE documents."""
    n = max(docs.count(), 1)
    return docs.filter(F.pmod(F.xxhash64(F.lit(1), "_id", "_text"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)).dropDuplicates(["_text"])


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (feature, (feature if so, values), (feature if not, values)); base is the prior's log-odds."""

    base: float
    trees: tuple
    threshold: float
    #: On the held-out labels.
    precision: float = 0.0
    recall: float = 0.0

    def margin(self, x: Sequence[bool]) -> float:
        out = self.base
        for f, (g, a, b), (h, c, d) in self.trees:
            out += (a if x[g] else b) if x[f] else (c if x[h] else d)
        return out

    def expression(self, x: dict[str, Column]) -> Column:
        def leaf(side: tuple) -> Column:
            return F.when(x[FEATURES[side[0]]], F.lit(side[1])).otherwise(F.lit(side[2]))

        out = F.lit(self.base)
        for f, yes, no in self.trees:
            out = out + F.when(x[FEATURES[f]], leaf(yes)).otherwise(leaf(no))
        return out


def boost(table: list[tuple[tuple[bool, ...], int, int]], rounds: int = 16, rate: float = 0.5) -> tuple[float, tuple]:
    """Newton boosting of depth-two trees on distinct feature vectors with (count, positives). All splits of a round are weighed at once by sums over pairs of features."""
    total, good = sum(n for _, n, _ in table), sum(p for _, _, p in table)
    base = math.log((good + 1) / (total - good + 1))
    x = np.array([v for v, _, _ in table], dtype=np.float64).reshape(len(table), len(FEATURES))
    n, pos = (np.array([r[k] for r in table], dtype=np.float64) for k in (1, 2))
    margins, trees = np.full(len(table), base), []

    def sides(w: np.ndarray) -> np.ndarray:
        """Sums of w by the values of the first and the second feature: yes-yes, yes-no, no-yes, no-no."""
        both, one = x.T @ (x * w[:, None]), x.T @ w
        return np.stack([both, one[:, None] - both, one[None, :] - both, w.sum() - one[:, None] - one[None, :] + both])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margins))
        g, h = sides(pos - n * p), sides(n * p * (1 - p)) + 1.0
        gain, value = (g * g / h).round(9), rate * g / h
        yes, no = gain[0] + gain[1], gain[2] + gain[3]
        f = int((yes.max(axis=1) + no.max(axis=1)).argmax())
        a, b = int(yes[f].argmax()), int(no[f].argmax())
        tree = (f, (a, float(value[0, f, a]), float(value[1, f, a])), (b, float(value[2, f, b]), float(value[3, f, b])))
        margins += np.where(x[:, f] > 0, np.where(x[:, a] > 0, tree[1][1], tree[1][2]), np.where(x[:, b] > 0, tree[2][1], tree[2][2]))
        trees.append(tree)
    return base, tuple(trees)


def fit(spark: SparkSession, docs: DataFrame | None = None, precision: float = 0.97) -> dict[str, Trees]:
    """Trees for each kind, with the lowest threshold that keeps the precision on the held-out half. docs: _id, _text."""
    rows = training_table(spark)
    if docs is not None:
        rows = rows.unionByName(labelled(_sampled(docs)))
    x = features(F.col("t"), F.col("l"))
    rows = rows.select("source", "kind", "held_out", *[x[f].alias(f) for f in FEATURES]).groupBy("source", "held_out", *FEATURES).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"is_{k}") for k in MODELS]).orderBy("source", "held_out", *FEATURES).collect()
    out = {}
    for kind, source in MODELS.items():
        of = lambda held: [(tuple(r[f] for f in FEATURES), r["n"], r[f"is_{kind}"]) for r in rows if r["source"] == source and r["held_out"] == held]  # noqa: E731, B023
        base, trees = boost(of(False))
        model = Trees(base, trees, math.inf)
        scored = sorted(((model.margin(x), n, p) for x, n, p in of(True)), reverse=True)
        n = p = 0
        every = sum(x for _, _, x in scored)
        best = (math.inf, 0.0, 0.0)
        for k, (m, count, pos) in enumerate(scored):
            n, p = n + count, p + pos
            last = k + 1 == len(scored) or scored[k + 1][0] < m - 1e-9
            if last and p >= precision * n:
                best = (m - 1e-6, p / n, p / every if every else 0.0)
        out[kind] = Trees(base, trees, *best)
    return out


# -- the operator ----------------------------------------------------------------------------------------------------


def _span(kind: str, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _base(kind: str) -> Column:
    return F.transform(F.filter(F.col(f"_s_{kind}"), lambda x: valid(kind, x["t"])), lambda x: _span(kind, x))


def _ends(x: Column) -> Column:
    """The candidates of one start of a number: up to the end of each group of digits."""
    of = lambda n: F.regexp_extract(x["t"], rf"^[+(]?[0-9](?:{_BETWEEN}[0-9]){{{n - 1}}}(?![0-9A-Za-z])", 0)
    there = F.filter(F.array(*[of(n) for n in range(SHORTEST, LONGEST + 1)]), lambda t: t != "")
    return F.transform(there, lambda t: F.struct(x["s"].alias("s"), (x["s"] + F.length(t)).alias("e"), t.alias("t"), x["l"].alias("l")))


def _touches(c: Column) -> Column:
    """Whether a candidate overlaps a base span. Those of one kind lie in order and apart: only the last one that begins before the candidate's end can."""

    def meets(spans: Column) -> Column:
        def halve(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            before = F.get(spans, mid)["s"] < c["e"]
            return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(before, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(before, a["hi"]).otherwise(mid).alias("hi")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"))
        return F.coalesce(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda a: F.get(spans, a["lo"] - 1)["e"] > c["s"]), F.lit(False))

    each = F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return F.when(F.size("base") <= FEW, each).otherwise(reduce(or_, [meets(F.col(f"_b_{k}")) for k in KINDS]))


def _candidates() -> Column:
    """All candidates, with the generator that proposes them."""
    named = lambda spans, source: F.transform(spans, lambda x: F.struct(F.lit(source).alias("source"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["l"].alias("l")))
    return F.concat(named(F.flatten(F.transform("_s_number", _ends)), "number"), named(F.col("_s_address"), "address"), named(F.col("_s_host"), "host"))


def _selected(candidates: Column, models: dict[str, Trees]) -> Column:
    """Structs of candidates that touch no base span and reach the threshold of a kind; the first in order is the best."""

    def scores(c: Column) -> Column:
        x = F.struct(*[v.alias(f) for f, v in features(c["t"], c["l"]).items()])
        under = lambda kind, m, x: F.when(c["source"] == MODELS[kind], F.lit(m.threshold) - m.expression({f: x[f] for f in FEATURES}))
        unusual = lambda x: ~(x["groups_334"] | x["groups_4444"] | x["plain"])
        each = lambda x: F.array(*[F.struct(under(k, m, x).alias("under"), unusual(x).alias("unusual"), (c["s"] - c["e"]).alias("shorter"), c["s"].alias("s"), c["e"].alias("e"), F.lit(k).alias("kind")) for k, m in models.items()])
        return F.filter(F.transform(F.array(x), each)[0], lambda k: k["under"] <= 0)  # bound to a variable, features are computed once

    return F.flatten(F.transform(F.filter(candidates, lambda c: ~_touches(c)), scores))


def _settled(selected: Column) -> Column:
    """The best of those that overlap."""
    kind = "array<struct<under:double,unusual:boolean,shorter:int,s:int,e:int,kind:string>>"
    none = F.array().cast(kind)

    def best(cs: Column) -> Column:
        return F.aggregate(F.array_sort(cs), none, lambda a, c: F.when(F.exists(a, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), a).otherwise(F.concat(a, F.array(c))))

    def of_clusters(cs: Column) -> Column:
        """cs by start: a cluster begins where all before have ended."""
        begins = lambda tops: F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: F.get(cs, i)["s"] >= F.get(tops, i))
        clusters = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda j: best(F.slice(cs, F.get(at, j) + 1, F.coalesce(F.get(at, j + 1), F.size(cs)) - F.get(at, j))))
        return F.flatten(_bound(_bound(_tops(F.transform(cs, lambda c: c["e"])), begins), clusters))

    by_start = lambda cs: F.transform(F.array_sort(F.transform(cs, lambda c: F.struct(c["s"].alias("at"), c.alias("c")))), lambda x: x["c"])
    return _bound(selected, lambda cs: F.when(F.size(cs) <= FEW, best(cs)).otherwise(_bound(by_start(cs), of_clusters)))


def _kept(kind: str) -> Column:
    return F.filter(F.col(f"_s_{kind}"), lambda x: valid(kind, x["t"]))


def _spanned(df: DataFrame) -> DataFrame:
    """From _id and _text: adds the matches of all patterns and generators, and the base spans by kind and together."""
    text = F.col("_text")
    wanted = {k: (PATTERNS[k], text.contains(NEEDS[k]) if NEEDS[k] else text.rlike("[0-9]"), 0) for k in KINDS}
    df = _with_spans(df, wanted | {"number": (NUMBER, text.rlike(NUMBER_NEEDS), 1), "address": (ADDRESS, text.rlike(ADDRESS_NEEDS), 1), "host": (HOST, text.rlike(HOST_NEEDS), 1)})
    df = df.withColumns({f"_b_{k}": _base(k) for k in KINDS})
    return df.withColumn("base", F.concat(*[f"_b_{k}" for k in KINDS]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict[str, Trees] | None = None) -> DataFrame:
    """A row for each row of df: the id, base (array of structs kind, s, e in the order of KINDS, then start) and all (with the added spans). models: fitted on df unless given."""
    df = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    models = models or fit(df.sparkSession, df)
    df = _spanned(df).select("_id", "_s_number", "_s_address", "_s_host", "base", *[f"_b_{k}" for k in KINDS])
    df = df.withColumn("_n", _settled(_selected(_candidates(), models)))
    added = lambda k: F.transform(F.filter("_n", lambda c: c["kind"] == k), lambda c: _span(k, c))
    df = df.withColumns({f"_a_{k}": added(k) for k in KINDS})
    every = [F.array_sort(F.concat(f"_b_{k}", f"_a_{k}")) for k in KINDS]
    return df.select(F.col("_id").alias(id_col), *[F.size(f"_b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base", F.concat(*every).alias("all"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", models: dict[str, Trees] | None = None) -> DataFrame:
    """df with the spans of find() replaced in the text column; overlapping spans become one mark. Repeated rows stay, and all columns, whatever their names."""
    # The row travels as one value, so that no name of its own meets another.
    packed = df.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("t"))
    found = find(packed, "row", "t", models)
    own = F.col("row").getField(text_col)
    text = F.coalesce(own, F.lit(""))

    def piece(spans: Column, begin: Column, end: Column) -> Column:
        """The text from begin to end, with the spans that lie there replaced; cut out first, as a position is found by counting from the start."""
        step = lambda own: lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(own, a["at"] - begin + 1, x["s"] - a["at"]), F.lit(mark))).alias("out"))
        whole = lambda own: F.aggregate(spans, F.struct(begin.alias("at"), F.lit("").alias("out")), step(own), lambda a: F.concat(a["out"], F.substring(own, a["at"] - begin + 1, end - a["at"])))
        return _bound(F.substring(text, begin + 1, end - begin), whole)

    def pieces(spans: Column) -> Column:
        begin = lambda tops, i: F.when(i == 0, 0).otherwise(F.get(tops, i * BLOCK))
        end = lambda tops, i: F.coalesce(F.get(tops, (i + 1) * BLOCK), F.length(text))
        each = lambda tops: F.transform(_blocks(spans), lambda b, i: piece(b, begin(tops, i), end(tops, i)))
        return F.array_join(_bound(_tops(F.transform(spans, lambda x: x["e"])), each), "")

    spans = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    kept = F.when(F.size("all") == 0, text).otherwise(_bound(spans, pieces))
    return found.select(F.col("row").withField(f"`{text_col}`", F.when(own.isNotNull(), kept)).alias("row")).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
