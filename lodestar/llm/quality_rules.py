"""Quality rules as a ledger: every rule is evaluated once, its verdict is a bit; policies are masks over the bits.

`ledger` reads each text once and stores what it measured and, in `failed`, a bit for each rule that the text breaks. A policy names
rules and how many of them a text may break; `with_policies` decides with one AND and one count of bits, so a new version of a policy
reads no text. `ablations` sums the rows of each distinct value of `failed` first, whose number is bounded by the rules and not by the
rows, and finds for every rule of every policy how many texts it alone keeps out. DataFrame functions only; nothing is shuffled but these sums.

Words are `[^\\x20\\x09-\\x0D]+`. A null text has none and measures 0 everywhere; so it breaks only the rule of few words. Null ids and repeated rows are rows like
others; extra columns are ignored, whatever their names; an empty table gives empty results. Repeated windows are told apart by 64 bits of hash within their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import named

SPACES = r"[\x20\x09-\x0D]"
TRIMMED = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]+"
#: Words of a window.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """broken: SQL over the measures, never null."""

    name: str
    broken: str


@dataclass(frozen=True)
class Policy:
    """A text is kept if it breaks at most `tolerated` of the rules, none of them `strict`."""

    version: str
    rules: tuple[str, ...]
    strict: tuple[str, ...] = ()
    tolerated: int = 0


#: The place of a rule is its bit, so new rules go to the end and none is ever taken away.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("stutters", "100 * n_stutters > 20 * n_words"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the policy, the oldest first.
POLICIES = (
    Policy("1", BASE),
    Policy("2", tuple(r.name for r in RULES)),
    Policy("3", tuple(r.name for r in RULES), BASE, 1),
)
#: What decides in production.
CURRENT = POLICIES[1]


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column) -> Column:
    """Words within windows that occur more than once."""

    def of_hashes(hashes: Column) -> Column:
        # get takes the same time at any place of an array
        of_window = lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW)))
        windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), of_window)
        return named(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(order: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(order, k)["h"] == e["h"], F.lit(False))
            found = F.filter(order, lambda e, k: F.when(k > 0, same(e, k - 1)).otherwise(False) | same(e, k + 1))
            return named(F.sort_array(F.transform(found, lambda e: e["i"])), spans)

        def spans(starts: Column) -> Column:
            to_next = F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(to_next, F.lit(0).cast("long"), lambda total, n: total + n)

        return named(placed, again)

    return named(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measured(text: Column) -> Column:
    """A struct of MEASURES, all long."""

    def of_words(words: Column) -> Column:
        stutter = F.filter(words, lambda w, i: F.when(i > 0, F.get(words, i - 1) == w).otherwise(False))
        return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), _repeat_words(words).alias("n_repeat_words"), F.size(stutter).alias("n_stutters"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    def of_text(text: Column) -> Column:
        bare = F.btrim(text, F.lit(TRIMMED))
        words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACES}+"))
        # runs of lines without a word become one line break, so that they make no strings
        lines = F.filter(F.split(F.regexp_replace(text, rf"\n{SPACES}*\n", "\n"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(named(words, of_words).alias("w"), named(lines, of_lines).alias("l"), _without(text, SYMBOLS).alias("n_symbols"), _without(text, "[A-Z]+").alias("n_capitals"))

    found = {"n_symbols": (), "n_capitals": ()} | {n: ("l",) for n in ("n_lines", "n_dup_lines")}

    def flat(s: Column) -> Column:
        return F.struct(*((s[n] if n in found and not found[n] else s["l" if n in found else "w"][n]).cast("long").alias(n) for n in MEASURES))

    return named(named(F.coalesce(text, F.lit("")), of_text), flat)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of rules."""
    bits = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, MEASURES, and failed, a bit for each of at most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")
    rows = docs.select(F.col(id_col).alias("id"), measured(F.col(text_col)).alias("m")).select("id", "m.*")
    bits = [F.when(F.expr(r.broken), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    failed = F.lit(0).cast("long")
    for b in bits:
        failed = failed.bitwiseOR(b)
    return rows.select(F.col("id").alias(id_col), *MEASURES, failed.alias("failed"))


def kept(policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | None = None) -> Column:
    """Whether a policy keeps a row of the ledger."""
    failed = F.col("failed") if failed is None else failed
    few = F.bit_count(failed.bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long"))) <= policy.tolerated
    return few & (failed.bitwiseAND(F.lit(mask(policy.strict, rules)).cast("long")) == 0)


def with_policies(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a column kept_<version> for each policy."""
    return rows.withColumns({f"kept_{p.version}": kept(p, rules) for p in policies})


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each rule of each policy: version, rule, n_docs, n_broken (by the rule), n_kept (by the policy), n_kept_without (by the policy without
    the rule) and n_alone, the texts that the rule alone keeps out. No rows for an empty ledger."""
    sums = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = []
    for p in policies:
        for name in p.rules:
            less = Policy(p.version, tuple(r for r in p.rules if r != name), tuple(r for r in p.strict if r != name), p.tolerated)
            broken = F.col("failed").bitwiseAND(F.lit(mask((name,), rules)).cast("long")) != 0
            cases.append(F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), broken.alias("broken"), kept(p, rules).alias("kept"), kept(less, rules).alias("without")))
    spread = sums.select("n", F.inline(F.array(*cases)))
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return spread.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        n(F.col("broken")).alias("n_broken"),
        n(F.col("kept")).alias("n_kept"),
        n(F.col("without")).alias("n_kept_without"),
        n(F.col("without") & ~F.col("kept")).alias("n_alone"),
    )
