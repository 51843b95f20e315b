"""How far the sources of a language differ in their words: exact divergences between all pairs of groups by inclusion and exclusion over supports.

A group is a (lang, source), null counting as ''. Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; a language keeps its V terms that are in
at least `least_docs` of its rows. With count c of a term in a group of N kept occurrences, p = 1 + floor(10^9 * (c + 2) / (N + 2V)), and two groups differ
at a term by f(p, q) = floor((p - q)^2 / (p + q)). Most terms are missing in one or both of two groups, where p is the group's constant z, its p at count 0. So

    sum f(p, q) = V * f(zp, zq)                                                    a constant for what is in neither
                + sum over p's support of f(p, zq) - f(zp, zq), and the other way     from each group's histogram of counts
                + sum over both supports of f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)

and only the last, the overlap, looks at terms of two groups. It comes from the postings, dealt and sorted by term: a task keeps one sum for each pair of groups that it
has met and gives those, so no pair of postings is ever a row. Work on a term grows with the square of the groups that have it, rows do not; a term
in most documents is summed before it is sent. p and f are exact in 64 bits: p and q are at most 10^9 + 1.

Rows are documents: repeated rows count as often as they occur. A null or empty text has no terms; its group stands in the result even so. In a language without kept
terms all values are 0. Columns other than text, lang and source are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import batch, materialize, small

#: Of UTF-8 bytes whose A-Z are lower-cased: every byte of a longer character is above 0x7F.
TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
LEAST_DOCS = 10
RANKS = 10
#: Distinct terms that a task may hold before it passes their counts on, and bytes of a text that are cut into terms at once.
HELD, PIECE = 1 << 18, 1 << 22


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes, cut between terms."""
    start = 0
    while len(text) - start > PIECE:
        gap = GAP.search(text, start + PIECE)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, d documents: parts of sums. The empty term stands for a group's documents."""

    def given(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            size = len(n) + 1
            yield batch(
                lang=pa.array([lang] * size, pa.string()), source=pa.array([source] * size, pa.string()), term=pa.array([b"", *n], pa.binary()),
                n=pa.array([0, *n.values()], pa.int64()), d=pa.array([0, *(d[t] for t in n)], pa.int64()),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = {}, 0
        for b in batches:
            langs, sources, texts = b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")
            for k in range(b.num_rows):
                n, d = groups.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                held -= len(n)
                own = set()
                for piece in _pieces((texts[k].as_py() or "").encode().lower()):
                    found = TERM.findall(piece)
                    n.update(found)
                    own.update(found)
                d.update(own)
                held += len(n)
                if held > HELD:
                    yield from given(groups)
                    groups, held = {}, 0
        yield from given(groups)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text.alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, d long").withColumn("term", F.col("term").cast("string"))


def share(count: str, total: str, kinds: str) -> Column:
    """p, of SQL for a count, its group's N and V; null if both are 0."""
    return F.expr(f"1 + CAST(1000000000 AS decimal(10, 0)) * CAST({count} + 2 AS decimal(20, 0)) div nullif(CAST({total} + 2 * {kinds} AS decimal(20, 0)), 0)")


def difference(p: str, q: str) -> Column:
    """f; 0 where the language has no terms."""
    return F.coalesce(F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"), F.lit(0).cast("long"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def overlaps(postings: DataFrame) -> DataFrame:
    """Of postings (lang, term, source, p, z): sums of corrections as lang, a, b, value for groups a and b that share terms, each pair both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        sums: Counter = Counter()
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            begins = _runs(rows)
            last = int(np.flatnonzero(begins)[-1])
            held = rows.slice(last)
            _add(rows.slice(0, last), begins[:last], codes, sums)
        if held is not None:
            _add(held, _runs(held), codes, sums)
        names, found = list(codes), list(sums.items())
        for at in range(0, len(found), 1 << 16):
            pairs = [(names[a], names[z], v) for (a, z), v in found[at : at + (1 << 16)]]
            yield batch(lang=pa.array([a[0] for a, _, _ in pairs], pa.string()), a=pa.array([a[1] for a, _, _ in pairs], pa.string()), b=pa.array([z[1] for _, z, _ in pairs], pa.string()), value=pa.array([v for *_, v in pairs], pa.int64()))

    sorted_by_term = postings.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term")
    half = sorted_by_term.mapInArrow(run, "lang string, a string, b string, value long")
    return half.select("lang", F.inline(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))))


def _runs(rows: pa.Table) -> np.ndarray:
    """Where a row's (lang, term) is not that of the row before."""
    lang, term = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "term"))
    out = np.ones(len(lang), bool)
    out[1:] = (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
    return out


def _add(rows: pa.Table, begins: np.ndarray, codes: dict, sums: Counter) -> None:
    """Add what whole runs of a term correct."""
    if not rows.num_rows:
        return
    run = np.cumsum(begins)
    group = np.array([codes.setdefault(g, len(codes)) for g in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())], np.int64)
    p, z = (rows.column(c).to_numpy() for c in ("p", "z"))
    for step in range(1, len(run)):
        first = np.flatnonzero(run[step:] == run[:-step])
        if not len(first):
            break
        second = first + step
        value = _f(p[first], p[second]) - _f(p[first], z[second]) - _f(z[first], p[second]) + _f(z[first], z[second])
        pair, at = np.unique(np.minimum(group[first], group[second]) << 32 | np.maximum(group[first], group[second]), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, at, value)
        for code, v in zip(pair.tolist(), total.tolist()):
            sums[code >> 32, code & 0xFFFFFFFF] += v


def _ranked(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with what a small table says of their language, each with each of its groups. A table that is too large to be sent is dealt by language and a part of the rows."""
    sent = small(groups, 160)
    if sent is not groups:
        return rows.join(sent, "lang")
    parts = 64
    spread = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).join(spread, ["lang", "part"]).drop("part")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language, part `term` the first `ranks` kept terms that the group uses more than its language."""
    parts = counted(docs).repartition("lang", "term")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = W.partitionBy("lang", "term")
    over_term = sums.select("lang", "term", "source", "n", F.sum("d").over(term).alias("docs"), F.sum("n").over(term).alias("in_lang"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = materialize(over_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"))

    # a group's N, and V and N of its language; a group without terms has a row for its documents
    real = F.col("term") != ""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real & F.col("first")).alias("kinds"))
    lang = W.partitionBy("lang")
    groups = materialize(by_group.select("lang", "source", "total", F.sum("kinds").over(lang).alias("kinds"), F.sum("total").over(lang).alias("lang_total")).withColumn("z", share("0L", "total", "kinds")))
    terms = kept.where(real).join(small(groups, 160), ["lang", "source"])
    postings = terms.select("lang", "term", "source", "n", share("n", "total", "kinds").alias("p"), share("in_lang", "lang_total", "kinds").alias("q"), "z")

    top = _ranked(postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))).where(F.col("rank") <= ranks)

    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    both = lambda rows: _with_groups(rows, others).where("source <> item")
    neither = both(groups.select("lang", "source", "kinds", "z")).select("lang", "source", "item", (F.col("kinds") * difference("z", "other")).alias("value"))
    histogram = postings.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("k"))
    one = both(histogram).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (difference("p", "other") - difference("z", "other"))).alias("value"))
    other_way = F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value")))
    shared = overlaps(postings).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    pairs = neither.unionByName(one.select("lang", other_way)).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return _ranked(pairs.withColumn("part", F.lit("pair"))).select(*columns).unionByName(top.select(*columns))
