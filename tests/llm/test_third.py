"""Operators 11 to 13 against SQL and brute force."""

import os
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from lodestar.llm import divergence, quality_rules, queries, whitening
from lodestar.llm.common import table


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", ["op11_divergence", "op13_quality_rules", "quality_ablations"])
def test_sql(spark, db, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    got = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
    assert sorted(frame.columns) == sorted(names) and sorted(map(repr, got)) == sorted(map(repr, want)) and got


def brute_audit(rows, least, ranks):
    """rows: (lang, source, text)."""
    counts, docs, langs = {}, Counter(), {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.setdefault((lang, source), Counter()).update(found)
        langs.setdefault(lang, set()).add(source)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s]}
            parts["term"] = [(-f(shares[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, items in parts.items():
                for rank, (value, item) in enumerate(sorted(items)[: None if part == "pair" else ranks], 1):
                    out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


WORDS = ["a", "b", "Straße", "É", "x", "Ab", "aB", "中文", "0", "…", "z" * 50]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "de", None, ""]), st.sampled_from(["s", "t", "ü", None]), st.one_of(st.none(), st.lists(st.sampled_from(WORDS)).map(" ".join))), min_size=1, max_size=30), st.sampled_from([1, 2, 4]))
def test_divergence_random(spark, rows, least):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, n long")
    assert sorted(map(tuple, divergence.audit(docs, least, 3).collect())) == brute_audit(rows, least, 3)


def test_divergence_forms(spark, monkeypatch):
    """Flushed counts, cut texts, batches that end within a term, a table of groups that isn't sent."""
    rows = [("en", f"s{k % 7}", " ".join(f"w{chr(97 + (k * j) % 23)}" for j in range(k % 31))) for k in range(200)]
    want = brute_audit(rows, 10, 10)
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 8)
    monkeypatch.setattr(divergence, "small", lambda df, row_bytes: df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_odd(spark):
    schema = "doc_id long, text string, lang string, source string, term string, n long, d long, p long, value long, item string, part string, z long"
    rows = [(None, t, "en", s, "x", 0, 0, 0, 0, "x", "x", 0) for t, s in [(None, None), ("", "s"), ("a" * 3_000_000, "s"), (" a" * 3_000_000, "t"), ("a b", "t"), ("a b", "t"), ("1 2 …", "u")]]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema), 2).collect()))
    assert got == brute_audit([(r[2], r[3], r[1]) for r in rows], 2, 10)
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0


def test_large_counts(spark):
    """p is exact where 64 bits would not hold the product."""
    row = spark.sql("SELECT 800000000000L AS n, 16000000000000L AS total, 50000000L AS kinds").select(divergence.share("n", "total", "kinds").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (8 * 10**11 + 2) // (16 * 10**12 + 10**8)


def brute_whiten(rows, k=4):
    """rows: (id, vector). Exact sums; covariance from fractions."""
    good = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for length in {len(x) for _, x in good if x}:
        fit = sorted({x for _, x in good if len(x) == length})
        n, s = len(fit), [sum(x[j] for x in fit) for j in range(length)]
        centred = np.array([[float(Fraction(x[j]) - Fraction(s[j], n)) for j in range(length)] for x in fit])
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
        for i, x in good:
            if len(x) == length:
                c = np.array([float(Fraction(x[j]) - Fraction(s[j], n)) for j in range(length)])
                out.setdefault((i, x), []).append((n, sum((n * x[j] - s[j]) ** 2 for j in range(length)), c @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)))
    return out


def test_whitening(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (8, None), (9, [None] * 64), (10, [float("nan")] * 64), (11, [float("inf")] + [0.0] * 63)]
    want = brute_whiten(rows)
    frame = whitening.whiten(spark.createDataFrame([(*r, 1, 1.0) for r in rows], "vec_id long, embedding array<float>, n long, x double").repartition(3))
    got = frame.collect()
    assert len(got) == 4 * (len(rows) - 4) and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    by, vectors = {}, {}
    for i, v in rows[: len(rows) - 4]:
        vectors.setdefault(i, []).append(tuple(int(np.floor(256 * c)) for c in v))
    for r in got:
        assert r["identity_error"] <= 1e-9
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    signs = {}
    for (i, x), cases in want.items():
        n, deviation, whitened, explained = cases[0]
        rs = by[i, deviation]
        for c in range(1, 5):
            r = rs[c]
            assert r["n"] == n and abs(r["explained"] - explained[c - 1]) < 1e-9
            if abs(whitened[c - 1]) > 1e-3:
                signs.setdefault(c, set()).add(round(r["whitened"] / whitened[c - 1], 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 4


def test_whitening_odd(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), (None, [2.0, 9.0]), ("a", [1.0, 2.0]), ("c", [7.0]), ("d", []), ("e", None), ("f", [1e300, -1e300, 0.0]), ("g", [0.0, 1.0, 2.0]), ("h", [-0.001, 1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r["vec_id"] for r in got) == {"a": 4, "b": 2, None: 2, "c": 1, "f": 3, "g": 3, "h": 3}
    c = next(r for r in got if r["vec_id"] == "c")
    assert (c["n"], c["deviation"], c["whitened"], c["explained"], c["identity_error"]) == (1, 0, None, 0.0, None)
    assert {r["deviation"] for r in got if r["vec_id"] == "f"} == {None}
    two = [r for r in got if r["vec_id"] in ("a", "b", None)]
    assert all(r["n"] == 3 and r["identity_error"] < 1e-9 for r in two)
    assert {r["deviation"] for r in two if r["vec_id"] == "b"} == {(3 * 768 - 1536) ** 2 + (3 * 1280 - 4096) ** 2}


def test_deviations_near_the_limit():
    x = np.array([[2**40, 5], [2**20, -3], [0, 0], [3 * 10**9, 0], [2**62, -(2**62)]])
    n, sums = 7, [int(v) for v in x.sum(0)]
    fit = whitening.Fit(n, sums, np.array([s / n for s in sums]), None, None)
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, fit) == [e if e < 2**63 else None for e in exact]
    y = np.array([[10**9, 3], [-(10**9), 4], [17, 5]])
    fit = whitening.Fit(3, [17, 12], np.array([17 / 3, 4.0]), None, None)
    assert whitening.deviations(y, fit) == [e if e < 2**63 else None for e in (sum((3 * a - s) ** 2 for a, s in zip(row, [17, 12])) for row in y.tolist())]


def test_packed_vectors():
    x = np.array([[1, -2], [40_000, 0], [2**40, 1], [-(2**63), 2**63 - 1]])
    found = sorted(map(tuple, np.concatenate(list(whitening.unpacked(pa.array(whitening.packed(x), pa.binary())))).tolist()))
    assert found == sorted(map(tuple, x.tolist()))


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda p: len(re.findall(p, text))
    return (len(w), sum(map(len, w)), count(r"[#*$%&|<>]"), len(lines), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(w, w[1:])), count("[A-Z]"))


TEXTS = st.lists(st.sampled_from(["a", "b", "A", "c c", "#", "|x", "é", "🙂", "\n", "\n\n", " \n ", "\r", "\t", "\x0b", " ", "a b c d e f g h", "z" * 30]), max_size=60).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=12))
def test_measures_random(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.ledger(docs).collect():
        want = brute_measures(texts[r["doc_id"]])
        assert tuple(r[m] for m in quality_rules.MEASURES) == want
        values = dict(zip(quality_rules.MEASURES, want))
        assert r["failed"] == sum(1 << k for k, rule in enumerate(quality_rules.RULES) if eval(rule.broken, {}, values))


def test_measures_odd(spark, odd, empty):
    texts = ["x " * 300_000, " " * 3_000_000, "\n" * 2_000_000 + "a", "#" * 2_000_000, "z" * 3_000_000, "a b c d e f g h i " * 60_000, "Ab\n" * 300_000]
    docs = odd.select("doc_id", "text", "n", "kept").unionByName(spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, n long, kept string"))
    got = quality_rules.ledger(docs).collect()
    want = [(r["doc_id"], *brute_measures(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, ((r["doc_id"], *(r[m] for m in quality_rules.MEASURES)) for r in got))) == sorted(map(repr, want))
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty)).count() == 0


def test_policies(spark):
    rules = (quality_rules.Rule("a", "n_words < 2"), quality_rules.Rule("b", "n_symbols > 0"), quality_rules.Rule("c", "n_capitals > 0"))
    policies = (quality_rules.Policy("1", ("a",)), quality_rules.Policy("2", ("a", "b", "c"), ("a",), 1))
    rows = quality_rules.ledger(spark.createDataFrame([(1, "x"), (2, "x #"), (3, "X #"), (4, "x y"), (5, "X y"), (6, "#")], "doc_id long, text string"), rules)
    kept = {r["doc_id"]: (r["kept_1"], r["kept_2"]) for r in quality_rules.with_policies(rows, policies, rules).collect()}
    assert kept == {1: (False, False), 2: (True, True), 3: (True, False), 4: (True, True), 5: (True, True), 6: (False, False)}
    got = {(r["version"], r["rule"]): tuple(r)[2:] for r in quality_rules.ablations(rows, policies, rules).collect()}
    assert got == {("1", "a"): (6, 2, 4, 6, 2), ("2", "a"): (6, 2, 3, 5, 2), ("2", "b"): (6, 3, 3, 4, 1), ("2", "c"): (6, 2, 3, 4, 1)}


def test_rules_have_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op13_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_keep_clean_documents(spark, sf_dir):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    found = queries.op13_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in found if r["quality"] == 1]
    junk = [r["kept"] for r in found if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
