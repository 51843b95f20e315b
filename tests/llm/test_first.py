"""Operators 1 to 5 and 10 against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lodestar.llm import decontamination, exact_dedup, html_text, language_id, packing, token_counts
from lodestar.llm.common import table
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_items(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, odd, empty, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    key = repr
    found = decontamination.find_items(docs, items)
    assert sorted(rows(found, "doc_id", "n_words", "n_hit", "items"), key=lambda r: key(r[:1])) == sorted(((a, b, c, d) for a, b, c, d in brute_items(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))), key=lambda r: key(r[:1]))
    odd_items = spark.createDataFrame([(1, "quick brown fox"), (2, "Fox"), (3, None), (4, ""), (None, "dog"), (2, "fox"), (5, "wort wort wort wort wort wort wort wort wort wort wort"), (6, "lazy dog"), (7, "dix onze")], "item_id long, text string")
    want = brute_items(rows(odd, "doc_id", "text"), [r for r in rows(odd_items, "item_id", "text") if r[0] is not None])
    assert sorted(map(repr, ((*r[:3], list(r[3])) for r in rows(decontamination.find_items(odd, odd_items), "doc_id", "n_words", "n_hit", "items")))) == sorted(map(repr, want))
    assert decontamination.find_items(empty, odd_items).count() == 0
    assert decontamination.find_items(odd, odd_items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 5)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["quick brown fox", "lazy dog", "runs far away", "short", "deux trois"])], "item_id long, text string")
    assert {(r["doc_id"], tuple(r["items"])) for r in decontamination.find_items(odd, items).where("n_hit > 0").collect()} == {(1, ("0", "1", "2")), (4, ("0", "1", "2")), (9, ("3",)), (None, ("4",))}


def check_packing(rows, docs, path, end=1, length=2048):
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    padding = tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        tokens += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / tokens


def test_packing(spark, odd, empty, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    assert check_packing(packing.pack_documents(docs, path).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], path) < 0.005
    unique = odd.where("doc_id is null or doc_id not in (3, 9)")
    check_packing(packing.pack_documents(unique, path).collect(), [tuple(r) for r in unique.select("doc_id", "text").collect()], path)
    assert packing.pack_documents(odd.where("doc_id = 9"), path).count() >= 2
    assert packing.pack_documents(empty, path).count() == 0


def test_pack_examples(spark):
    rows = [(k, 100 + k * 37 % 900, 1 + k % 3, k * 13 % 400) for k in range(3000)] + [(-1, 5000, 1, 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv long, t long, s long, l long").repartition(3)
    out = packing.pack_examples(df, (2048, 8, 1024), "conv", "t", "s", "l").collect()
    assert sorted(r["conv"] or 10**9 for r in out if r["conv"] != 0) == sorted(r[0] or 10**9 for r in rows if r[0] != 0)
    size, bins = {r[0]: [x or 0 for x in r[1:]] for r in rows}, {}
    for r in out:
        if r["fits"]:
            bins.setdefault(r["sequence_id"], []).append(size[r["conv"]])
    assert [r["conv"] for r in out if not r["fits"]] == [-1]
    assert all((np.sum(b, axis=0) <= (2048, 8, 1024)).all() for b in bins.values())
    assert len(bins) < 1.1 * max(sum(s[k] for s in size.values()) / (2048, 8, 1024)[k] for k in range(3))


def dot_product_packing(rows, limits):
    """The heuristic over all rows at once: fill a sequence by what fits with the largest dot product of relative sizes and room."""
    waiting, sequences = dict(enumerate(rows)), []
    while waiting:
        left, mine = np.array(limits), []
        while True:
            room = [z / y for y, z in zip(limits, left.tolist())]
            able = [(s[0] / limits[0] * room[0] + s[1] / limits[1] * room[1] + s[2] / limits[2] * room[2], -k) for k, s in waiting.items() if (np.array(s) <= left).all()]
            if not able:
                break
            k = -max(able)[1]
            left = left - waiting.pop(k)
            mine.append(k)
        sequences.append(sorted(rows[k] for k in mine))
    return sorted(sequences)


def test_pack_examples_against_brute_force(spark, empty):
    """The same sequences, and each of the three limits is what closes some sequence."""
    rng = np.random.default_rng(4)
    rows = [tuple(int(x) for x in (rng.integers(50, 300), rng.integers(1, 4), rng.integers(0, 50))) for _ in range(60)]
    rows += [tuple(int(x) for x in (rng.integers(10, 40), rng.integers(5, 12), rng.integers(0, 10))) for _ in range(60)]
    rows += [tuple(int(x) for x in (rng.integers(250, 300), 1, rng.integers(200, 250))) for _ in range(60)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, t long, s long, l long").coalesce(1)
    for bound, limits in ((None, (1400, 24, 700)), (0, (900, 100, 5000)), (1, (20000, 15, 5000)), (2, (20000, 100, 400))):
        got = {}
        for r in packing.pack_examples(docs, limits, "id", "t", "s", "l").collect():
            got.setdefault(r["sequence_id"], []).append(r["id"])
        assert sorted(sorted(rows[k] for k in mine) for mine in got.values()) == dot_product_packing(rows, limits)
        full = [np.sum([rows[k] for k in mine], axis=0) / limits for mine in got.values()]
        assert bound is None or any(f.argmax() == bound and f[bound] > 0.9 for f in full)
    assert packing.pack_examples(docs.limit(0), limits, "id", "t", "s", "l").count() == 0


def test_packed_conversations(spark, sf_dir):
    path, out = public_tokenizers.path("byte_bpe_50k.json"), QUERIES["packed_conversations"](spark, sf_dir).collect()
    tokenizer, sizes = Tokenizer.from_file(path), {}
    for r in table(spark, sf_dir, "conversations").collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        sizes.setdefault(r["conv_id"], []).append((n, 1, n if r["role"] == "assistant" else 0))
    assert {r["conv_id"]: (r["tokens"], r["segments"], r["loss"]) for r in out} == {k: tuple(np.sum(v, axis=0)) for k, v in sizes.items()} and len(out) == len(sizes)
    bins = {}
    for r in out:
        if r["fits"]:
            bins.setdefault(r["sequence_id"], []).append((r["tokens"], r["segments"], r["loss"]))
    assert all((np.sum(b, axis=0) <= (8192, 32, 6144)).all() for b in bins.values()) and len(bins) < len(sizes) / 3
    odd = spark.createDataFrame([(1, "assistant", None), (1, None, "a b"), (None, "user", ""), (None, "user", "")], "conv_id long, role string, text string")
    got = {r["conv_id"]: (r["segments"], r["loss"]) for r in packing.conversation_sizes(odd, path).collect()}
    assert got == {1: (2, 1), None: (2, 0)}
    assert packing.conversation_sizes(odd.limit(0), path).count() == 0


def test_packing_refuses_other_merges(tmp_path):
    """An encoder that merges by ids is no good where ids do not rank as merges."""
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["model"]["merges"][100], spec["model"]["merges"][101] = spec["model"]["merges"][101], spec["model"]["merges"][100]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        packing.byte_bpe(str(tmp_path / "t.json"))


def test_language(spark, odd, empty):
    out = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 40")
    held = out.where("held_out").join(truth, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) a").first()["a"]
    assert held > 0.97
    model = language_id.train(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (1, "en"), (None, "fr"), (7, "de")} <= got
    assert all(0 <= r["score"] <= 1 for r in language_id.identify(odd, model).collect())
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_language_of_short_words(spark):
    """A language whose words are too short for the longest n-grams spoils no score."""
    rows = [(1, "ab cd ab", "xx"), (2, "wonderful mountains", "en"), (3, None, "en"), (4, "gh", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got[1][0] == "xx" and got[2][0] == "en" and got[3] == ("und", 0.0)
    model = language_id.train(docs)
    for text in ("wonderfully mountainous", "mountain abcd", "zzz"):
        lang, score = model.predict(text)
        assert lang in ("en", "xx") and 0 < score <= 1
    assert model.predict("wonderfully mountainous")[0] == "en"
    assert language_id.train(docs.where("lang = 'xx'")).predict("ab") == ("xx", 1.0)


def test_language_memory_of_unseen_words(spark, monkeypatch):
    """Unseen words beyond those remembered count as well, in this text and in later ones."""
    docs = spark.createDataFrame([(1, "eins zwei drei vier", "de"), (2, "one two three four", "en")], "doc_id long, text string, lang string")
    texts = ["einser zweier dreier vierer viertel", "onefold twofold threefold fourth", "zweig onely drei", "one"]
    want = [language_id.train(docs).predict(x) for x in texts]
    monkeypatch.setattr(language_id, "REMEMBERED", 2)
    model = language_id.train(docs)
    got = [model.predict(x) for x in texts * 2]
    assert [x[0] for x in got] == [x[0] for x in want] * 2
    assert np.allclose([x[1] for x in got], [x[1] for x in want] * 2)


def test_language_of_many_labels(spark, monkeypatch):
    """Every label, word and n-gram of the sample is in the model, however many there are, and however little of it is remembered."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, letters[k % 26] + letters[k // 26] + letters[k * 7 % 26] + "q", f"l{k:03d}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 100 and all(model.predict(t)[0] == lang for _, t, lang in rows)
    monkeypatch.setattr(language_id, "MEMORY_BYTES", 100 * 8 * 3)
    assert all(model.predict(f"{t} {t} zz {t}")[0] == lang for _, t, lang in rows)


def test_language_of_a_very_long_word(spark):
    """One word of a million letters costs what it is long, not that for every word."""
    many = lambda first: " ".join(f"{first}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))
    docs = spark.createDataFrame([(1, "ab" * 500_000 + " " + many("x"), "xx"), (2, many("w"), "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.predict("ab" * 500_000)[0] == "xx" and model.predict("waa wbb")[0] == "en" and model.predict("abababa")[0] == "xx"


def brute_language(rows):
    """A scorer that keeps plain dictionaries of counts: rows of (text, lang) to a function of a text."""
    counts = {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault((0, lang), Counter())[w] += 1
            for n in range(1, 6):
                padded = " " + w + " "
                counts.setdefault((n, lang), Counter()).update(padded[i : i + n] for i in range(len(padded) - n + 1))
    names = sorted({lang for _, lang in counts})

    def log(n, lang, x):
        own = counts.get((n, lang)) or Counter()
        total = sum(own.values()) or max(sum(c.values()) for (m, _), c in counts.items() if m == n)
        return np.log((own[x] or 0.5) / total)

    def word(w, lang):
        if any(w in counts[0, x] for x in names):
            return log(0, lang, w)
        for n in range(5, 0, -1):
            padded = " " + w + " "
            known = [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if any(g in counts.get((n, x), ()) for x in names)]
            if known:
                return np.mean([log(n, lang, g) for g in known])
        return 0.0

    def predict(text):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            return "und", 0.0
        memo = {}
        total = np.array([sum(memo[w, x] if (w, x) in memo else memo.setdefault((w, x), word(w, x)) for w in found) for x in names])
        p = np.exp(total - total.max())
        return names[int(np.argmax(p))], float(p.max() / p.sum())

    return predict


def test_language_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    train = [(t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(str(i).encode()) % 4 != 2][:40]
    small = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.train(small)).collect()}
    predict = brute_language(train)
    for i, text, _ in sorted(rows, key=lambda r: len(r[1] or ""))[:120]:
        lang, score = predict(text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == 11
    by = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert by == {(1, 1, 1, True), (4, 4, 1, True), (2, 2, 3, True), (3, 2, 3, False), (None, None, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 2, True)}
    assert {r["text_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_counting_quotient_filter():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 20, 3000, dtype=np.uint64) for _ in range(5)]
    filters = [exact_dedup.CountingQuotientFilter.build(*np.unique(p, return_counts=True), 9, 20) for p in parts]
    values, counts = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.loads(f.dumps()) for f in filters]).entries()
    assert dict(zip(values.tolist(), counts.tolist())) == Counter(np.concatenate(parts).tolist())


def test_token_counts(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd, path).collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for t in texts) == sorted((r["n_bytes"], r["n_tokens"]) for r in got)
    assert sum(r["over_limit"] for r in got) == 1
    assert token_counts.token_counts(empty, path).count() == 0
    count = token_counts.TokenCounter(path)
    rng = np.random.default_rng(2)
    letters = list("aAbe'sStlL é́İΣß1²½_-.,\n\t\x1c\x85 –€ǅx中") + ["<|endoftext|>", "<|startoftext|>", "'re", "the "]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    letters = list("abÉ ё\u0301жΣςσα中文字😀‍👩🏽e\u0301\u0308 \u3000\u2009.,'sт\n") + ["<|endoftext|>", "привет", "слово мир", "λόγος", "  "]
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 24)))
        assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="x">
<header>Site</header><nav><ul><li>Home</ul></nav><div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header>
<p>One  two<br>three &eacute;<p>Four<div class="comments"><p>No</p></div><form>Q<input></form></article><aside>x</aside><footer>&copy;</footer>"""


def test_html(spark):
    notice = "we use many small things here to make this page work for you"
    pages = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "x", "")]
    pages += [(10 + k, "http://b.example/", f"<body><div>{notice}</div><p>Text number {k} with own words {k * 7}</p>") for k in range(6)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, part int")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert got[1]["text"] == "A & B\nOne two three é\nFour" and got[1]["n_chars"] == 26
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert all(got[10 + k]["text"] == f"Text number {k} with own words {k * 7}" for k in range(6))
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_class_names():
    """A class that only says how a page is laid out takes no article, nor does one in an article that a furniture word is a part of."""
    text = lambda page: [t for z, t in html_text.blocks(page) if z == html_text.ARTICLE]
    zone = lambda page: [z for z, _ in html_text.blocks(page)]
    for name in ("page has-sidebar", "no-sidebar", "header-fixed", "with-menu", "sidebar", "header", "page site-header", "x menu_open"):
        assert text(f'<div class="{name}"><article><p>One</p></article></div>') == ["One"], name
        assert text(f'<div id="{name}"><div><main>One<div class="share-buttons">No</div></main>No</div></div>') == ["One"], name
    for name in ("related-work", "legal-analysis", "social-history", "comment-on-law"):
        assert text(f'<article><p>One</p><div class="{name}"><p>Two</p></div></article>') == ["One", "Two"], name
    for name in ("ad", "site-footer", "main-nav", "cookie_notice", "x sidebar-left", "related-posts", "comments"):
        assert zone(f'<div class="{name}">No</div>') == [html_text.FURNITURE], name
        assert text(f'<article>One<div class="{name}"><p>No</p></div></article>') == ["One"], name
    assert text("<article>a <math><mi>x</mi></math> <object>b</object><textarea>no</textarea></article>") == ["a x b"]
    for page in ('<div class="comments"><article>No</article></div>', '<aside><article>No</article></aside>', '<div class="menu"><nav><article>No</article></nav></div>', '<div class="menu" hidden><main>No</main></div>', '<main><div class="menu"><article>No</article></div></main>'):
        assert zone(page) == [html_text.FURNITURE], page


@pytest.mark.parametrize("group_bytes", [1 << 23, 1000])
def test_html_repeats_of_a_host(spark, group_bytes):
    """A passage on three pages goes whatever the size of the host, and so do short blocks that repeat together; ids that repeat are one page."""
    rare, twice = "this rare passage stands on three pages of the large host only", "that one stands twice on the host and so it always stays here"
    pages = []
    for k in range(60):
        more = rare if k in (3, 31, 59) else twice if k in (7, 40) else f"nothing{k}"
        menu = "<ul><li>All news</li><li>Our weather</li><li>The sports pages</li><li>Share this</li></ul>"
        pages.append((k, f"http://large.example/{k}", f"<body>{menu}<p>own{k} text{k} of{k} this{k}</p><p>{more}</p></body>"))
    pages += [(200, "http://large.example/a", f"<article>kept {rare}</article><p>other</p>"), (7, "http://large.example/7", pages[7][2]), (None, "http://large.example/n", "<p>null</p>"), (None, None, f"<p>{rare}</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = html_text.main_text(df, group_bytes=group_bytes).collect()
    assert len(got) == len(pages)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    for k in range(60):
        more = "" if k in (3, 31, 59) else "\n" + (twice if k in (7, 40) else f"nothing{k}")
        assert text[k, f"http://large.example/{k}"] == f"own{k} text{k} of{k} this{k}{more}"
    assert text[200, "http://large.example/a"] == f"kept {rare}" and text[None, "http://large.example/n"] == "null" and text[None, None] == rare


@pytest.mark.parametrize("group_bytes", [1 << 23, 1000])
def test_html_template_within_articles(spark, group_bytes):
    """What half of a host's pages repeat within their articles goes; what fewer of them share is a quotation and stays."""
    notice, quote = "sign up here for all the letters that we send each day", "he said that nobody would ever read so far into this"
    pages = [(k, f"http://n.example/{k}", f"<article><p>own{k} a{k}</p>{f'<p>{notice}</p>' if k % 3 else ''}<p>{quote if k < 7 else f'b{k}'}</p></article>") for k in range(20)]
    pages += [(100 + k, f"http://few.example/{k}", f"<article><p>{notice}</p><p>c{k}</p></article>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), group_bytes=group_bytes).collect()}
    assert all(got[k] == f"own{k} a{k}\n{quote if k < 7 else f'b{k}'}" for k in range(20))
    assert all(got[100 + k] == f"{notice}\nc{k}" for k in range(5))


def test_html_of_a_large_host(spark):
    """Three pages of two thousand share a passage, and a very long page and its repeated rows go through."""
    rare = "one two three four five six seven eight nine ten"
    pages = [(k, f"http://h.example/{k}", f"<p>x{k} y{k}</p><p>{rare if k in (5, 999, 1998) else f'z{k}'}</p>") for k in range(2000)]
    long = " ".join(f"l{k}" for k in range(200_000))
    pages += [(5000, "http://h.example/l", f"<p>{long}</p><p>{rare}</p>")] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (1 << 23, 1 << 10):
        rows = html_text.main_text(df, group_bytes=size).collect()
        got = {r["page_id"]: r["text"] for r in rows}
        assert len(rows) == 2002 and got[5000] == long
        assert all(got[k] == (f"x{k} y{k}" if k in (5, 999, 1998) else f"x{k} y{k}\nz{k}") for k in range(2000))


def brute_text(pages, least=3, template=8, share=0.5, tokens=8):
    """Counts by dictionary on how many pages of its host each run of tokens is."""
    host = lambda url: url.split("/")[2].lower() if url and "://" in url else ""
    where, of_host, out = {}, {}, {}
    parsed = {i: html_text.blocks(h or "") for i, _, h in pages}
    for i, url, _ in pages:
        of_host.setdefault(host(url), set()).add(i)
        t = [x for _, text in parsed[i] for x in text.split(" ")]
        for k in range(len(t) - tokens + 1):
            where.setdefault((host(url), *t[k : k + tokens]), set()).add(i)
    removed = 0
    for i, url, _ in pages:
        zone = max([z for z, _ in parsed[i]], default=0)
        need = max(template, -(-share * len(of_host[host(url)]) // 1)) if zone == html_text.ARTICLE else least
        t = [x for _, text in parsed[i] for x in text.split(" ")]
        starts = [k for k in range(len(t) - tokens + 1) if len(where[(host(url), *t[k : k + tokens])]) >= need]
        every, at, kept = {k + j for k in starts for j in range(tokens)}, 0, []
        for z, text in parsed[i]:
            own = text.split(" ")
            end = at + len(own)
            if z == zone and z != html_text.FURNITURE and not all(k in every for k in range(at, end)):
                gone = {k + j for k in starts if at <= k and k + tokens <= end for j in range(tokens)}
                kept.append(" ".join(x for k, x in enumerate(own, at) if k not in gone))
            if z == zone and z != html_text.FURNITURE:
                removed += len(own) - (len(kept[-1].split(" ")) if kept and not all(k in every for k in range(at, end)) else 0)
            at = end
        out[i] = "\n".join(kept)
    return out, removed


@pytest.mark.parametrize("group_bytes", [1 << 23, 2000])
def test_html_against_brute_force(spark, group_bytes):
    """The given pages, as they are and without their article elements, where the array decides alone and takes text away."""
    pages = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    bare = [(i, url, re.sub("</?(article|nav|footer)>", "", h or "")) for i, url, h in pages]
    for rows, takes in ((pages, False), (bare, True)):
        want, removed = brute_text(rows)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), group_bytes=group_bytes).collect()}
        assert got == want and (removed > 0) == takes


@pytest.mark.parametrize("seed", range(4))
def test_repeated_runs(seed):
    rng = np.random.default_rng(seed)
    streams = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(8)]
    pages = np.array([0, 1, 2, 3, 3, 4, 4, 5])
    where = {}
    for s, p in zip(streams, pages):
        for i in range(len(s) - 3):
            where.setdefault(tuple(s[i : i + 4]), set()).add(p)
    for s, run in zip(streams, html_text.repeated_runs(streams, pages, 4, 3)):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 3):
            if len(where[tuple(s[i : i + 4])]) >= 3:
                want[i : i + 4] = True
        assert (run == want).all()


def test_sql_is_for_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
