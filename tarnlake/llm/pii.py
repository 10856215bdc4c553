"""Personal data: patterns propose spans, validators confirm them, and context
words nearby adjust a score that decides on the weaker kinds.

Base kinds (email, ip, card, phone) stand by pattern and validator alone.  The
method adds iban (length of its country and mod 97, in upper or lower case), ssn
(needs a context word), access_key and secret.
DataFrame functions only; positions are code points, ends exclusive.

Patterns are written with possessive repeats and a start that a run of equal
class allows once, so that no text costs more than linear time; they match the
same spans as the plain forms.

Defined cases: a null text is empty and has no spans; rows with a null id,
repeated rows and empty tables are carried through; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

CONTEXT = 40  # code points before and after a span that are searched for context words
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without this string, or any character of this [class], has no span
    base: bool = False
    score: float = 1.0  # of a confirmed span
    context: str = ""  # a pattern of words near it that add 0.5
    ahead: bool = False  # the pattern takes the start only, its group 1 is the span


IBAN = """15 NO | 16 BE | 18 DK FI FO GL NL FK SD | 19 MK SI | 20 AT BA EE KZ LT LU MN XK | 21 CH HR LI LV
22 BG BH CR DE GB GE IE ME RS VA | 23 AE GI IL IQ OM SO TL | 24 AD CZ ES MD PK RO SA SE SK TN VG | 25 AO CV GW LY MZ PT ST
26 DZ IR IS TR | 27 BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD | 28 AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG
29 BR EG PS QA UA | 30 JO KW MU YE | 31 MT SC | 32 LC | 33 RU"""  # lengths by country, ISO 13616 and in partial use


def _iban() -> str:
    """Starts are tried one by one, as a wrong one may hide an IBAN behind it.  A
    country that is not listed has the longest run of upper-case characters."""
    rows = [x.split() for x in IBAN.replace("\n", "|").split("|")]
    known = [f"(?:{'|'.join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{int(n) - 4}}}" for n, *codes in rows]
    other = f"(?!{'|'.join(c for _, *codes in rows for c in codes)})(?-i:[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})"
    return rf"(?i)\b(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join([*known, other])})\b))[A-Z]{{2}}[0-9]{{2}}"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    Kind("iban", _iban(), "[0-9]", ahead=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, r"(?i)\b(?:ssn|social|security|tax)\b"),
    Kind("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "A"),
    Kind("secret", r"(?i)\b(?:password|passwd|token|secret|api_?key)\b[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9_+/-]{8,}[\"']?", "[=:]", False, 0.8),
)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35."""
    s = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.try_to_number(part(p), F.lit("999")) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


_NONE = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(t: Column, kind: Kind) -> Column:
    """All confirmed spans of a kind: matches and the gaps between them give the places."""
    matches, gaps = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), F.split(t, kind.pattern, -1)
    if kind.ahead:
        whole = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(1))
        matches = F.zip_with(matches, whole, lambda m, w: F.struct(m.alias("m"), w.alias("w")))
    else:
        matches = F.transform(matches, lambda m: F.struct(m.alias("m"), m.alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.char_length(x["g"])
        e = s + F.char_length(x["w"])
        fine = x["w"].isNotNull() & F.coalesce(_valid(kind.name, x["w"]), F.lit(False))
        if kind.ahead:  # of overlapping spans the first stands
            fine = fine & F.coalesce(F.try_element_at(a["found"], F.lit(-1))["e"] <= s, F.lit(True))
        return F.struct(
            F.coalesce(s + F.char_length(x["m"]), s).cast("int").alias("at"),
            F.when(fine, F.array_append(a["found"], F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), x["w"].alias("m"))))
            .otherwise(a["found"]).alias("found"),
        )

    pairs = lambda m: F.zip_with(gaps, m, lambda g, x: F.struct(g.alias("g"), x["m"].alias("m"), x["w"].alias("w")))
    found = _let(matches, lambda m: F.when(F.size(m) > 0, F.aggregate(pairs(m), start, step)["found"]))

    def scored(x: Column) -> Column:
        score = F.lit(kind.score)
        if kind.context:
            before = F.substr(t, F.greatest(F.lit(1), x["s"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["s"]))
            after = F.substr(t, x["e"] + 1, F.lit(CONTEXT))
            near = F.regexp_like(before, F.lit(kind.context)) | F.regexp_like(after, F.lit(kind.context))
            score = score + F.when(near, F.lit(0.5)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

    spans = F.filter(F.transform(found, scored), lambda x: x["score"] >= THRESHOLD)
    cheap = F.regexp_like(t, F.lit(kind.needs)) if kind.needs.startswith("[") else F.contains(t, F.lit(kind.needs))
    return F.coalesce(F.when(cheap, spans), F.array().cast(_NONE))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and, by kind, an array of (kind, start, end, score)."""
    t = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    return t.select("doc_id", *[_spans(F.col("t"), k).alias(k.name) for k in KINDS])


def _joined(kinds: list[Kind]) -> Column:
    words = [F.transform(F.col(k.name), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*words), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    base = [k for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(list(KINDS)).alias("spans"),
        F.array_join(F.concat(*[F.transform(F.col(k.name), lambda x: F.round(x["score"], 2).cast("string")) for k in KINDS]), ",").alias("scores"),
    )
