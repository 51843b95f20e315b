"""The queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, divergence, exact_dedup, html_text, jaccard_join, language_id, lm_scoring, packing, pseudonyms, quality_rules, suffix_dedup, token_counts, whitening
from .common import table

#: The setting that names the environment variable of the executors that holds the key of the pseudonyms, so that neither settings nor plans have it. Without it, as in tests, the key
#: is one that protects nothing.
KEY_SETTING, NO_KEY = "spark.lodestar.pseudonymSecretVariable", "not-a-secret"
#: Of packed conversations: tokens, turns and learned tokens of a sequence.
CONVERSATION_LIMITS = (8192, 32, 6144)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under three limits at once."""
    sizes = packing.conversation_sizes(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_examples(sizes, CONVERSATION_LIMITS, "conv_id", "tokens", "segments", "loss")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where("not held_out"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), language_id.held_out(of=7))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: counts and the base score, from the same operator."""
    return op7_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = spark.conf.get(KEY_SETTING, None)
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), NO_KEY if name is None else pseudonyms.key_of_executors(name))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current policy's verdict; no policy keeps what breaks a rule of the base."""
    base = (F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE)).cast("long"))) != 0
    kept = ~base & quality_rules.kept(quality_rules.CURRENT)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.ledger(table(spark, sf_dir, "documents")).select(*columns, base.alias("base_failed"), kept.alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version of the policy keeps out."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_packing, packed_conversations, op3_language_id, op4_html_extraction, op5_exact_dedup, op6_suffix_dedup, op7_lm_scoring, lm_base_scores, op8_jaccard_join, op9_pseudonyms, op10_token_counts, op11_divergence, op12_whitening, op13_quality_rules, quality_ablations)
}

_DEDUP = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NOT_SPACE = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_ITEMS = f"""
WITH it AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT m, array_to_string(w[i:i + m - 1], ' ') AS win, coalesce(list(DISTINCT item) FILTER (item IS NOT NULL), []) AS items
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM it WHERE len(w) > 0))
  GROUP BY ALL),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
met AS (SELECT doc_id, i, m, items FROM places JOIN windows USING (m, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM met) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_LINKED = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_NOT_SPACE} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(4, len(w)) AS m FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS to_ FROM d UNION SELECT reach.v, edges.y FROM reach JOIN edges ON edges.x = reach.to_)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(to_) AS component_id FROM reach GROUP BY v) c USING (doc_id)
"""

_CRC = (
    "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
    "lambda c, b: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"
)

#: The end is a word that no text has: a space.
_BASE = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_NOT_SPACE}, ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1)::DOUBLE)), 4) AS base_score
FROM t LEFT JOIN c USING (w), s GROUP BY doc_id, held_out, n
"""

_F = "((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n, v FROM g JOIN kept USING (lang) JOIN kinds USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value FROM q a JOIN q b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {_F.format(p="p", q="q")} FROM q WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
often AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM often) GROUP BY k),
lines AS (SELECT k, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - kinds, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN lines USING (k) LEFT JOIN rep USING (k)),
r AS (
  SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeated_windows, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 50 * n_lines AS repeated_lines,
         100 * n_stutters > 20 * n_words AS stutters, 100 * n_capitals > 30 * word_chars AS capitals, word_chars > 20 * n_words AS long_words, word_chars < 2 * n_words AS short_words
  FROM m)
"""

_QUALITY = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_windows AS base_failed,
       NOT (few_words OR repeated_windows OR symbols OR repeated_lines OR stutters OR capitals OR long_words OR short_words) AS kept
FROM r
"""

_RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "stutters", "capitals", "long_words", "short_words")


def _ablation(version: str, rules: tuple[str, ...], strict: tuple[str, ...], tolerated: int, rule: str) -> str:
    def kept(less: str | None) -> str:
        broken = " + ".join([f"{r}::INT" for r in rules if r != less] or ["0"])
        return " AND ".join([f"({broken}) <= {tolerated}", *(f"NOT {r}" for r in strict if r != less)])

    return f"SELECT '{version}' AS version, '{rule}' AS rule, count(*) AS n_docs, count_if({rule}) AS n_broken, count_if({kept(None)}) AS n_kept, count_if({kept(rule)}) AS n_kept_without, count_if(({kept(rule)}) AND NOT ({kept(None)})) AS n_alone FROM r HAVING count(*) > 0"


_ABLATIONS = _LEDGER + " UNION ALL ".join(
    _ablation(*policy, rule) for policy in (("1", _RULES[:2], (), 0), ("2", _RULES, (), 0), ("3", _RULES, _RULES[:2], 1)) for rule in policy[1]
)

#: Of the other queries, SQL can express no part that is worth a query of its own; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": _ITEMS, "op5_exact_dedup": _DEDUP, "op8_jaccard_join": _LINKED, "lm_base_scores": _BASE, "op11_divergence": _DIVERGENCE, "op13_quality_rules": _QUALITY, "quality_ablations": _ABLATIONS}
