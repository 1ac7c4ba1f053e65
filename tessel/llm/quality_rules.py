"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one long of failure bits; policies are
versioned masks over these bits, so a new policy or an ablation needs no second look at the texts.  All of it is SQL
expressions on one row: no shuffle, no Python.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.

Defined cases: null and empty texts have no words, so they fail the base rules; repeated rows are judged each on its
own; extra columns are ignored, or kept by ``ledger``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def covered_words(starts: Column, width: int) -> Column:
    """How many words windows of ``width`` at the ascending ``starts`` cover."""
    begin = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, begin, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(width), s - a["last"])).alias("n")), lambda a: a["n"])


def repeated_words(found: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that the text has twice or more."""
    hashes = F.when(F.size(found) >= width, _let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))))

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(pairs, lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # most texts have no repeated window and need no sort
    return F.coalesce(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered_words(starts(h), width)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  #: SQL over the measurements


#: Bits are never given to another rule.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", 5, "2 * n_capitals > word_chars"),
    Rule("exclamations", 6, "5 * n_exclamations > n_words"),
)
BASE = ("few_words", "repeated_words")
#: What each version of the policy looks at.
POLICIES = {1: BASE, 2: tuple(r.name for r in RULES)}
BITS = {r.name: 1 << r.bit for r in RULES}


def mask(policy: int) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the measurements and ``fail_bits``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__words", words(text)).withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0))
    measured = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(_without(text, BLANKS)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
        "n_capitals": (F.length(text) - F.length(_without(text, CAPITALS))).cast("long"),
        "n_exclamations": (F.length(text) - F.length(_without(text, "!"))).cast("long"),

    }).drop("__words", "__lines")
    bits = F.expr(" + ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES))
    return measured.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """``rows`` of a ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    base = sum(BITS[name] for name in BASE)
    return rows.withColumn("base_failed", F.expr(f"(fail_bits & {base}L) <> 0")).withColumn("kept", F.expr(f"(fail_bits & {base | mask(policy)}L) = 0"))


def ablations(rows: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept without it."""
    all_bits = mask(policy)
    kept = F.count_if(F.expr(f"(fail_bits & {all_bits}L) = 0"))
    one = [
        F.struct(F.lit(name).alias("rule"), F.count_if(F.expr(f"(fail_bits & {BITS[name]}L) <> 0")).alias("failed"), F.count_if(F.expr(f"(fail_bits & {all_bits}L) = {BITS[name]}L")).alias("failed_alone"), F.count_if(F.expr(f"(fail_bits & {all_bits & ~BITS[name]}L) = 0")).alias("kept_without"), kept.alias("kept"), F.count("*").alias("documents"))
        for name in POLICIES[policy]
    ]
    return rows.agg(F.array(*one).alias("a")).select(F.inline("a"))


def quality_rules(docs: DataFrame, policy: int = max(POLICIES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, measurements, fail_bits, base_failed, kept."""
    out = apply_policy(ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), policy)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_capitals", "n_exclamations")
