"""Quality rules as a bitmask ledger.

ledger() evaluates every rule once per document: one bit per failed rule beside
the measurements.  write_ledger() stores it.  Policies are versioned masks over
those bits: apply_policies() and ablations() read the stored ledger and never look
at a text again.  DataFrame functions only.

Defined cases: a null text has no words and measures 0 everywhere, so it fails
too_few_words.  Rows with a null id, repeated rows and empty tables are carried
through row by row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, fresh_path, read_table, text_or_empty

WINDOW = 8  # words in a window of n_repeat_words
SYMBOLS = "#*$%&|<>"
LINE_END = r"[.!?][\x20\x09\x0B-\x0D]*(?:\n|\z)"  # of a line that ends a sentence

#: name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_word_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "digits": "100 * n_digits > 30 * word_chars",
    "line_ends": "n_word_lines >= 10 AND 100 * n_ended_lines < 5 * n_word_lines",
}
BASE = ("too_few_words", "repeated_words")

#: (version, rules whose failure rejects).
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": ("too_few_words", "repeated_words", "symbols"),
    "v2": ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
    "v3": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the sorted positions."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, s: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).cast("int").alias("n"), s.cast("int").alias("last")
    )
    return F.aggregate(starts, zero, step)["n"]


def _starts(sorted_grams: Column) -> Column:
    """Positions of the windows whose hash stands beside an equal one."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    pick = lambda x, j: same(F.get(sorted_grams, j - 1), x) | same(F.get(sorted_grams, j + 1), x)
    return F.array_sort(F.transform(F.filter(sorted_grams, pick), lambda x: x["i"]))


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the array."""
    n = F.size(words)
    grams = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, WINDOW)).alias("h"), i.cast("int").alias("i"))),
    )
    any_twice = lambda g: F.size(F.array_distinct(F.transform(g, lambda x: x["h"]))) < F.size(g)
    count = lambda g: F.when(any_twice(g), _let(F.sort_array(g), lambda s: _covered(_starts(s)))).otherwise(0)
    return F.coalesce(_let(grams, count), F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = text_or_empty(text_col)
    plain = F.btrim(t, F.lit(BLANKS))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        t.alias("t"),
        F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, BLANK_RE)).alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        chars.alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_word_lines"),
        (F.octet_length("t") - F.octet_length(F.translate("t", "0123456789", ""))).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit(LINE_END)).cast("long").alias("n_ended_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and fail_bits, one row per document."""
    bits = F.lit(0)
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("int"))


def write_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, stored as Parquet at path."""
    rows = ledger(docs, id_col, text_col)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(mask(POLICIES[policy])) == 0


def apply_policies(rows: DataFrame) -> DataFrame:
    """A boolean column kept_<version> for every policy."""
    return rows.withColumns({f"kept_{v}": verdict(v) for v in POLICIES})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: rows that fail it, rows that only it
    rejects, and rows kept were it left out."""
    full = mask(POLICIES[policy])
    hit = F.col("fail_bits").bitwiseAND(full)
    names = list(RULES)
    counts = rows.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))  # 2^rules rows at most
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in POLICIES[policy]]))
    return (
        counts.select("hit", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fail_bits: the bits of all rules; kept: by the policy CURRENT."""
    rows = write_ledger(read_table(spark, sf_dir, "documents"), fresh_path(spark, "quality-ledger"))
    failed = F.col("fail_bits").bitwiseAND(mask(BASE)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(CURRENT)).alias("kept"), "fail_bits",
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     m AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
     g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) > 8)),
     s AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
     r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s) GROUP BY doc_id),
     q AS (
  SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
         len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))) AS n_ended
  FROM m LEFT JOIN r USING (doc_id)),
     b AS (
  SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 100 * n_symbols > 20 * n_words AS r2, 100 * n_dup_lines > 30 * n_lines AS r3,
         n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS r4, 100 * n_digits > 30 * word_chars AS r5,
         n_lines >= 10 AND 100 * n_ended < 5 * n_lines AS r6
  FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4) AS kept,
       r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT AS fail_bits
FROM b
"""
