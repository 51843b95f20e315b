"""Main text of web pages: a suffix array over the pages of each host, and structure as the vote on what it may take.

A page becomes blocks of text, each in a zone: inside an article or main element, inside furniture
(menus, headers, footers, asides, forms, adverts, notices, comments), or neither; and it is one stream of the tokens of all its blocks. The streams of
a host are concatenated, and for every run of `least_tokens` tokens the suffix array tells on how many distinct pages of the host it is.

The text of a page is its article's blocks, or those of neither kind if it has no article, less what the host repeats:

- of neither kind: runs on at least `least_pages` pages
- in an article: runs on at least `template_pages` pages and on the share `template_share` of all pages of the host. Less is not enough there, since
  articles quote and copy each other

Pages of the same html count once. An article of which less than a tenth would be left is itself what is copied
(mirrors, print views) and stays whole, as does any text of which nothing would be left.
A block that such runs cover entirely goes, runs that cross blocks included; of another, only what runs within it cover, so
that a text keeps its first words where a repeated block precedes it.

The pages of a host of at most `group_bytes` meet in one task, as 32-bit hashes of their tokens. A larger host is
in no one task: hashes of its runs are counted in shards, summed within a batch first. Both find the same runs, up to collisions of
32-bit hashes of tokens and 64-bit hashes of runs.

Null or empty html gives an empty text. Pages without host are as of one host. Repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, batch, dealt, materialize, packed, small
from .textbytes import hashes_of, mix

#: SOFT: furniture by the class of an element around, in which an article may yet begin.
ARTICLE, NEUTRAL, FURNITURE, SOFT = 2, 1, 0, -1
#: Hashes of runs that one task merges, about, and that one batch gathers.
SHARD_RUNS = 1 << 20

#: Elements of HTML by their role.
RAW = frozenset("script style noscript template svg iframe title textarea select".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end where the next of their kind begins.
LOOSE = frozenset("p li dt dd tr td th option b i em strong u".split())
FURNITURE_WORDS = frozenset("nav navbar navigation menu sidebar side footer header masthead ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices gdpr comment comments disqus breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription popup modal login search pagination pager toolbar widget tags copyright legal skip".split())
#: A class name is one of FURNITURE_WORDS, or made of them and these: site-footer, but not has-sidebar or related-work.
PLACE_WORDS = frozenset("site page main global top bottom left right primary secondary inner outer box bar block list links link container wrapper wrap section area items item inline body text posts stories button buttons icons form".split())
#: Furniture that may be made of article elements.
LISTED_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comment comments disqus related recommended widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE_WORDS = frozenset("article articlebody entry-content post-content post-body article-body article-content main-content story-body".split())

#: A comment, a tag, a tag whose quotes don't pair, or another declaration.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[/!?][^>]*>?", re.S)
#: A name and its value; a value is never looked at as a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = re.compile("class|id|role|itemprop|hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")


@lru_cache(4096)
def _zone(tag: str, attributes: str, zone: int) -> int:
    """The zone of an element within zone. Furniture stays furniture, but an article in what only a class marks is one; furniture in an article is furniture."""
    if zone == FURNITURE or tag in FURNITURE_TAGS or (tag == "header" and zone != ARTICLE):
        return FURNITURE
    if attributes and TELLING.search(attributes):
        found: dict[str, str] = {}
        for k, v in ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), v.strip("\"'").lower())
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in FURNITURE_ROLES:
            return FURNITURE
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if tag not in ("body", "html", "article", "main") and not (zone == ARTICLE and tag in HEADINGS):
            marks = [p for p in (set(re.split(r"[^a-z]+", x)) - {""} for x in names.split()) if p & FURNITURE_WORDS and p <= FURNITURE_WORDS | PLACE_WORDS]
            if marks:
                return FURNITURE if zone == ARTICLE or any(p & LISTED_WORDS for p in marks) else SOFT
        if found.get("itemprop") == "articlebody" or found.get("role") in ("main", "article") or (zone != SOFT and set(names.split()) & ARTICLE_WORDS):
            return ARTICLE
    return ARTICLE if tag in ("article", "main") else zone


def _ends(inside: str, tag: str) -> bool:
    """Whether an element that may lack its end tag ends where another begins."""
    if inside == "p":
        return tag in BLOCK_TAGS
    return inside in LOOSE and (inside == tag or (inside in ("td", "th") and tag in ("td", "th", "tr")) or (inside in ("dt", "dd") and tag in ("dt", "dd")))


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every block that has text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, parts, at, size = NEUTRAL, [], 0, len(page)

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((max(zone, FURNITURE), text))
            parts.clear()

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            end()
            at = close.end() if close else size
            continue
        if tag in BLOCK_TAGS:
            end()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if not closing and stack and _ends(stack[-1][0], tag):
            end()
            zone = stack.pop()[1]
        if tag in LOOSE and not closing and not (attributes and _zone(tag, attributes, zone) < zone):
            continue  # only one that is furniture has a place on the stack
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != zone:
                        end()
                    zone = stack[k][1]
                    del stack[k:]
                    break
        elif not attributes.endswith("/") or tag in BLOCK_TAGS:
            inner = _zone(tag, attributes, zone)
            if inner != zone:
                end()
            stack.append((tag, zone))
            zone = inner
    end()
    return out


def pages_of_runs(streams: list, pages: np.ndarray, least_tokens: int) -> list[np.ndarray]:
    """For each stream and token, on how many distinct pages the run of least_tokens tokens that begins there is; 0 if none begins.

    The suffix array orders all positions by their first least_tokens tokens, by doubling."""
    lengths = np.array([len(s) for s in streams], np.int64)
    n = int(lengths.sum())
    if not n:
        return [np.zeros(0, np.int64) for _ in streams]
    rank = np.unique(np.concatenate([np.asarray(s) for s in streams if len(s)]), return_inverse=True)[1].astype(np.int64)
    which = np.repeat(np.arange(len(streams)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    done = 1
    while done < least_tokens:
        step = min(done, least_tokens - done)
        shifted = np.full(n, -1, np.int64)
        shifted[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + np.where(left > step, shifted, -1) + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[left[suffixes] >= least_tokens]
    found = np.zeros(n, np.int64)
    if len(suffixes):
        interval, page = rank[suffixes], pages[which[suffixes]]
        pair = np.unique(interval * (int(pages.max()) + 1) + page)
        of, count = np.unique(pair // (int(pages.max()) + 1), return_counts=True)
        found[suffixes] = count[np.searchsorted(of, interval)]
    return np.split(found, np.cumsum(lengths)[:-1])


def covered(starts: np.ndarray, least_tokens: int) -> np.ndarray:
    """Which tokens lie in one of the runs that begin at starts."""
    edges = np.zeros(len(starts) + least_tokens, np.int64)
    edges[: len(starts)] += starts
    edges[least_tokens:] -= starts
    return np.cumsum(edges)[: len(starts)] > 0


def repeated_runs(streams: list, pages: np.ndarray, least_tokens: int, least_pages: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of least_tokens tokens that is on least_pages distinct pages."""
    return [covered(n >= least_pages, least_tokens) for n in pages_of_runs(streams, pages, least_tokens)]


def token_hashes(texts: list[str]) -> np.ndarray:
    """Of the stream of these blocks, a hash of each token."""
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(data == 32)
    return hashes_of(data, np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]]))


def run_hashes(tokens: np.ndarray, host: int, least_tokens: int) -> np.ndarray:
    """The hash of host and the run of least_tokens tokens from each token on."""
    n = len(tokens) - least_tokens + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.array([host], np.int64).view(np.uint64)[0])
    for k in range(least_tokens):
        out = mix(out * np.uint64(3) + tokens[k : k + n])
    return out


def text_of(zones: list[int], texts: list[str], repeats: np.ndarray | None, least_tokens: int, least: dict[int, int]) -> str:
    """The text of a page. repeats: for each token of its stream, on how many pages the run that begins there is; least: on how many it is the host's, by zone."""
    zone = ARTICLE if ARTICLE in zones else NEUTRAL
    if repeats is None:
        return "\n".join(t for z, t in zip(zones, texts) if z == zone)
    starts = repeats >= least[zone]
    at, out, every = 0, [], covered(starts, least_tokens)
    whole = "\n".join(t for z, t in zip(zones, texts) if z == zone)
    if zone == ARTICLE:
        mine = np.concatenate([np.full(len(t.split(" ")), z == zone) for z, t in zip(zones, texts)])
        if 10 * (mine & ~every).sum() < mine.sum():
            return whole
    for z, text in zip(zones, texts):
        tokens = text.split(" ")
        end = at + len(tokens)
        if z == zone and not every[at:end].all():
            own = starts[at:end].copy()
            own[max(0, len(own) - least_tokens + 1) :] = False
            out.append(" ".join(t for t, c in zip(tokens, covered(own, least_tokens)) if not c) if own.any() else text)
        at = end
    return "\n".join(out) or whole


def main_text(
    pages: DataFrame, least_tokens: int = 8, least_pages: int = 3, template_pages: int = 8, template_share: float = 0.5, group_bytes: int = 8 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id_col, url_col, text, n_chars for every row. group_bytes changes how the work is done, never its result."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    base = base.withColumns({"page": F.xxhash64("host", "html"), "row": F.xxhash64("id", "url", "html")})
    kind = base.schema["id"].dataType.simpleString()
    sizes = materialize(base.groupBy("host").agg(F.count_distinct("page").alias("n"), F.sum(F.octet_length("html")).alias("bytes")))

    def streams(column: pa.Array) -> Iterator[np.ndarray]:
        for x in column:
            yield token_hashes([t for _, t in blocks(x.as_py() or "")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [t.astype(np.uint32).tobytes() for t in streams(b.column(3))]
            yield batch(host=b.column(0), n=b.column(1), row=b.column(2), tokens=pa.array(tokens, pa.binary()), page=b.column(4))

    def in_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("row")
        number = np.unique(pdf["page"].to_numpy(), return_inverse=True)[1]
        found = pages_of_runs([np.frombuffer(t, np.uint32) for t in pdf["tokens"]], number, least_tokens)
        at = [np.flatnonzero(n >= least_pages) for n in found]
        rows = pd.DataFrame({"row": pdf["row"], "hashed": False, "host_pages": pdf["n"], "at": at, "n": [n[a] for n, a in zip(found, at)]})
        return rows[[len(a) > 0 for a in at]]

    shape = "row long, hashed boolean, host_pages long, at array<long>, n array<long>"
    of_hosts = lambda hosts: base.join(small(hosts.select("host", "n"), 128), "host")
    large = F.coalesce(F.col("bytes") > group_bytes, F.lit(False))
    marks = of_hosts(sizes.where(~large)).select("host", "n", "row", "html", "page").mapInArrow(read, "host string, n long, row long, tokens binary, page long").groupBy("host").applyInPandas(in_group, shape)
    many = sizes.where(large)
    total = many.agg(F.sum("bytes")).first()[0]
    if total:
        # a token has about six bytes
        shards = max(16, -(-total // (6 * SHARD_RUNS)))
        again = materialize(base.groupBy("page").count().where("count > 1").select("page", F.lit(True).alias("repeats")))
        rows = of_hosts(many).join(small(again, 16), "page", "left").withColumn("at", F.xxhash64("host"))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs with on how many of the batch's pages they are; those of pages with several rows with the page instead."""
            once, several, held = [np.zeros(0, np.uint64)], [], 0

            def flush() -> pa.RecordBatch:
                runs, n = np.unique(np.concatenate(once), return_counts=True)
                names = np.concatenate([np.zeros(len(runs), np.int64), *(np.full(len(r), p) for r, p in several)])
                runs, n = np.concatenate([runs, *(r for r, _ in several)]), np.concatenate([n, np.ones(len(names) - len(n), np.int64)])
                return dealt((mix(runs) % np.uint64(shards)).astype(np.int64), runs=runs, n=n.astype(np.uint32), pages=names)

            for b in batches:
                for tokens, at, page, repeats in zip(streams(b.column(0)), *(c.to_pylist() for c in b.columns[1:])):
                    runs = np.unique(run_hashes(tokens, at, least_tokens))
                    if repeats:
                        several.append((runs, page))
                    else:
                        once.append(runs)
                    held += len(runs)
                    if held >= SHARD_RUNS:
                        yield flush()
                        once, several, held = [np.zeros(0, np.uint64)], [], 0
            if held:
                yield flush()

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            runs, n, names = packed(pdf["runs"], np.uint64), packed(pdf["n"], np.uint32).astype(np.int64), packed(pdf["pages"], np.int64)
            twice = np.flatnonzero(names)
            twice = twice[np.lexsort((names[twice], runs[twice]))]
            same = np.flatnonzero((runs[twice[1:]] == runs[twice[:-1]]) & (names[twice[1:]] == names[twice[:-1]])) + 1
            n[twice[same]] = 0
            runs, where = np.unique(runs, return_inverse=True)
            n = np.bincount(where, n, len(runs)).astype(np.int64)
            return pd.DataFrame({"run": runs[n >= least_pages].view(np.int64), "n": n[n >= least_pages]})

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                runs = [np.unique(run_hashes(tokens, at, least_tokens)) for tokens, at in zip(streams(b.column(0)), b.column(1).to_pylist())]
                each = [len(r) for r in runs]
                yield batch(row=pa.array(np.repeat(b.column(2).to_numpy(), each)), host_pages=pa.array(np.repeat(b.column(3).to_numpy(), each)), run=pa.array(np.concatenate([np.zeros(0, np.uint64), *runs]).view(np.int64)))

        counted = rows.select("html", "at", "page", F.coalesce("repeats", F.lit(False)).alias("repeats")).mapInArrow(deal, "shard long, runs binary, n binary, pages binary")
        repeated = materialize(counted.groupBy("shard").applyInPandas(settle, "run long, n long"))
        asked = rows.select("html", "at", "row", "n").dropDuplicates(["row"]) if not again.isEmpty() else rows.select("html", "at", "row", "n")
        found = asked.mapInArrow(ask, "row long, host_pages long, run long").join(small(repeated, 24), "run")
        gathered = found.groupBy("row", "host_pages").agg(F.collect_list(F.struct("run", "n")).alias("runs"))
        marks = marks.unionByName(gathered.select("row", F.lit(True).alias("hashed"), "host_pages", F.col("runs.run").alias("at"), F.col("runs.n").alias("n")))
    marks = materialize(marks)
    size = marks.agg(F.sum(F.size("at") * 16 + 64)).first()[0] or 0
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html_, host_, hashed, host_pages, at, n in zip(*(c.to_pylist() for c in b.columns[2:])):
                found = blocks(html_ or "")
                zones, texts, repeats = [z for z, _ in found], [t for _, t in found], None
                if at is not None:
                    tokens = token_hashes(texts)
                    repeats, at, n = np.zeros(len(tokens), np.int64), np.array(at, np.int64), np.array(n, np.int64)
                    if hashed:
                        order = np.argsort(at)
                        runs = run_hashes(tokens, host_, least_tokens).view(np.int64)
                        place = np.minimum(np.searchsorted(at[order], runs), len(at) - 1)
                        repeats[: len(runs)] = np.where(at[order][place] == runs, n[order][place], 0)
                    else:
                        repeats[at] = n
                least = {NEUTRAL: least_pages, ARTICLE: max(template_pages, math.ceil(template_share * (host_pages or 0)))}
                out.append(text_of(zones, texts, repeats, least_tokens, least))
            yield batch(id=b.column(0), url=b.column(1), text=pa.array(out, pa.string()))

    whole = base.withColumn("host_", F.xxhash64("host")).join(marks, "row", "left").select("id", "url", "html", "host_", "hashed", "host_pages", "at", "n")
    done = whole.mapInArrow(write, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
