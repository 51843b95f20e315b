"""Texts that once failed, and what contracts say of odd cases."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from lodestar.llm import decontamination, html_text, language_id, packing, pseudonyms, queries, token_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_long_white_space_has_the_ids_of_the_library():
    encoder, library = packing.byte_bpe(PATH), Tokenizer.from_file(PATH)
    long = packing.LONG_SPACE + 3
    for text in (" " * long, "a" + " " * long + "b", "\n" * long + "x", "a \n" + "\t " * long + " é", " " * long + "1" + " " * long + "!!", "x" * 9 + " " * (long - 4) + "y", "\x1c" * long + "z"):
        assert packing.encode(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_packing_of_megabytes_of_white_space(spark):
    texts = [" " * 1_200_000 + "x", "\n" * 2_000_000, "1" * 300_000, "a." * 300_000]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    for k, text in enumerate(texts):
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == mine[0]["doc_tokens"]
    encoder = packing.byte_bpe(PATH)
    ids = np.array([*packing.encode(encoder, texts[0]), 1], "<u4")
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows if r["doc_id"] == 0)


def test_pseudonyms_of_long_runs(spark):
    long = ["x@" + "a." * 5000 + "com", "a" * 1_000_000, "a." * 500_000, "@" * 1_000_000, "1" * 1_000_000, "1-" * 500_000, "1." * 500_000, "AB12 " * 200_000, "f" * 1_000_000, " " * 1_000_000, "+1 22 " * 100_000, "a@" * 300_000]
    short = ["mail a.b@mail.example.org.", "x@" + "ab." * 60 + "com"]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(long + short)), "doc_id long, text string"), "k").collect()}
    assert got[0]["text"] == long[0] and len(got) == len(long) + 2
    assert got[len(long)]["n_email"] == 1 and got[len(long)]["text"].endswith("@mail.invalid.") and got[len(long) + 1]["n_email"] == 1


def test_key_stays_out_of_the_plan(spark):
    docs = spark.createDataFrame([(1, "call +1 202 555 0123 or a@b.org")], "doc_id long, text string")
    found = pseudonyms.pseudonymize(docs, pseudonyms.key_of_executors("PATH"))
    import os

    assert os.environ["PATH"] not in found._jdf.queryExecution().toString()
    same = pseudonyms.pseudonymize(docs, os.environ["PATH"]).first()
    assert found.first()["text"] == same["text"] and same["n_values"] == 2



ARTICLES = [
    ('<article style="overflow:hidden">Some text here</article>', "Some text here"),
    ('<div style="overflow:hidden"><article>Some text here</article></div>', "Some text here"),
    ('<article data-hidden="false">Some <a href="/hidden-valley">Hidden Valley</a> text</article>', "Some Hidden Valley text"),
    ('<article><p>One</p><p class="cookie-notice">We use cookies<p>Two</article>', "One\nTwo"),
    ('<article><p>One</p><p hidden>gone</p><p>Two</p></article>', "One\nTwo"),
    ('<article><table><tr><td class="sidebar">Menu<td>Cell</table></article>', "Cell"),
    ('<article><ul><li class="advert">Buy<li>Keep</ul></article>', "Keep"),
    ('<article><h1 class="page-header">Title</h1><p>Body</p></article>', "Title\nBody"),
    ('<article><p class="a"">One</p><p title=it\'s>Two</p></article>', "One\nTwo"),
    ('<article><p hidden>gone<div>Stays</div></article>', "Stays"),
    ('<article>a < b and <b>c</b> &lt;d&gt;</article>', "a < b and c <d>"),
]


@pytest.mark.parametrize("html, want", ARTICLES)
def test_article_text(html, want):
    found = html_text.blocks(f"<html><body>{html}</body></html>")
    zone = html_text.ARTICLE
    assert "\n".join(t for z, t in found if z == zone) == want


@pytest.mark.parametrize("group_bytes", [8 << 20, 1])
def test_mirrored_pages_keep_their_article(spark, group_bytes):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10_000, n))
    copied, foot = words(60), "all rights reserved by the people who made this page for you"
    rows = [(k, f"http://h/{k}", f"<article><p>{copied}</p><p>{foot}</p></article><i>{k}</i>") for k in range(10)]
    rows += [(k, f"http://h/{k}", f"<article><p>{words(60)}</p><p>{foot}</p></article>") for k in range(10, 16)]
    rows += [(k, f"http://plain/{k}", f"<div>{copied}</div>") for k in range(16, 19)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group_bytes=group_bytes).collect()}
    assert all(copied in got[k] for k in (*range(10), 16, 17, 18)) and all(got[k] and foot not in got[k] for k in range(10, 16))


def test_letters_and_marks():
    assert language_id.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert language_id.words_of("½ ² ① ٣ _ -") == [] and language_id.words_of("straße été ét 中文 x1y") == ["straße", "été", "ét", "中文", "x", "y"]


def test_both_ways_find_the_same_words():
    import random

    rng = random.Random(4)
    pools = ["abz Ñé ß", "½²①٣_-", "हिन्दी", "中文カ", "🙂𝒳𐐷", "a\u0301e\u0301", "ªº\u02b0Ⅷ"]
    for _ in range(500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(30)))
        assert language_id.words_of(text) == language_id.WORD.findall(text)


def test_items_without_id(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} end"), (2, "none")], "doc_id long, text string")
    marks = spark.createDataFrame([(None, item), ("b", "none")], "item_id string, text string")
    assert sorted(tuple(r) for r in decontamination.find_items(docs, marks).select("doc_id", "n_hit", F.size("items")).collect()) == [(1, 10, 0), (2, 1, 1)]


def test_conversations_without_id(spark, tmp_path):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (1, 0, "user", "x"), (1, 1, None, None)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "t" / "conversations.parquet"))
    got = queries.packed_conversations(spark, str(tmp_path / "t")).collect()
    assert sorted((r["conv_id"] or 0, r["segments"]) for r in got) == [(0, 2), (1, 2)] and all(r["tokens"] > r["loss"] for r in got)


def test_other_tokenizer_files_are_refused(tmp_path):
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for path in (str(tmp_path / "t.json"), PATH):
        with pytest.raises(ValueError):
            token_counts.load(path)
    assert token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
