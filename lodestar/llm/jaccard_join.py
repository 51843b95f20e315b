"""Documents linked by the Jaccard similarity of their word n-grams, through prefixes under several global orders.

Under any one order of all shingles, two sets with similarity t share one of their first
n - ceil(t * n) + 1 shingles. Three orders are used, each of which linked documents must pass:

1. rare shingles first: shards of shingles count their documents and tell each run of documents which of its
   shingles occur again. A shingle of one document alone goes no further, and a document with enough of them is done; the
   other prefix shingles join documents into clusters, by chains in order of size, never by all pairs; the documents of a batch are chained
   first, so that a shingle of very many of them sends a few chains
2. and 3. within a cluster, ascending and descending hash, pair by pair: candidates pass both, and only they are verified

A cluster of more than `block` documents, or of long ones, is first held against PIVOTS documents of its own, wherever its documents are. What links
with a pivot is one part from then on, and the largest part of a cluster is never compared with itself again. While more than a block is outside that part, a further
order parts the cluster once more (documents that share no prefix shingle under it can't be linked), and pivots of what is outside follow. Only
what such rounds no longer lower by a tenth is dealt into blocks, and pairs of them, and of them with blocks of the largest part, are separate tasks. Only links that
join two parts are kept, then components are found by contraction. Equal sets are one class from the start.

A document without words or text is linked with nothing. Rows that repeat an id are one node; a null id links
nothing by itself and gets the component of its equals, null if there are none. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_BYTES, batch, by_arrow, components, dealt, materialize, packed, small
from .textbytes import NOT_SPACE, chunks, mix, shingles, word_hashes

SALT = np.uint64(0x5851F42D4C957F2D)
#: Shingles are told apart by 24 bits within shards of about so many, and documents by their number in a run of about so many bytes.
SHARD_SHINGLES, RUN = 1 << 17, 1 << 24
#: Packed values that one task merges, about; tokens of a block for each document that it may hold.
SHARD_VALUES, BLOCK_TOKENS = 1 << 20, 1024
#: Documents of a large cluster with which all others are compared.
PIVOTS = 4


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar; a is not above b."""
    return 100 * a >= percent * b


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in chunks(column):
        hashes, first = word_hashes(data, offsets, NOT_SPACE)
        for k in range(hi - lo):
            yield shingles(hashes[first[k] : first[k + 1]], size)


def _shards(values: int) -> int:
    return max(16, -(-values // SHARD_VALUES))


def _of(tokens: np.ndarray, shards: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(shards)).astype(np.int64)


class Forest:
    """Union-find over 0 .. n - 1 that tells whether a link joined two parts."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class _Index:
    """For each set, how many of its listed tokens every other set lists too."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(len(lists)), sizes)
        _, token = np.unique(np.concatenate(lists), return_inverse=True)
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(token))])
        self.token, self.at = token, np.concatenate([[0], np.cumsum(sizes)])

    def sharing(self, i: int) -> np.ndarray:
        """Of the sets before i, those that share a token."""
        t = self.token[self.at[i] : self.at[i + 1]]
        lo, n = self.edges[t], self.edges[t + 1] - self.edges[t]
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.zeros(len(self.at) - 1, bool)
        found[self.owner[where]] = True
        return found[:i]


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def candidate(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether both sorted sets have sizes that fit and share a token of their prefixes in ascending, and in descending order."""
    p, q = int(prefix_size(np.array(len(one)), percent)), int(prefix_size(np.array(len(two)), percent))
    if not fits(min(len(one), len(two)), max(len(one), len(two)), percent):
        return False
    meet = lambda x, y: len(np.intersect1d(x, y, assume_unique=True)) > 0
    return meet(one[:p], two[:q]) and meet(one[len(one) - p :], two[len(two) - q :])


def links(sets: list[np.ndarray], percent: int, parts_of: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest; sets: sorted token arrays; parts_of: sets with the same number, if it is not negative, are one part already."""
    n = np.array([len(x) for x in sets])
    p = prefix_size(n, percent)
    up = _Index([x[:k] for x, k in zip(sets, p)])
    down = _Index([x[len(x) - k :] for x, k in zip(sets, p)])
    forest, out, first = Forest(len(sets)), [], {}

    def link(i: int, j: int) -> bool:
        if not linked(sets[i], sets[j], percent):
            return False
        forest.join(i, j)
        out.append((i, j))
        return True

    parts = 0
    for i in range(len(sets)):
        part = parts_of[i] if parts_of else -1
        if part >= 0 and part in first:
            forest.join(i, first[part])
            # what is linked with one of its part already may be linked with others
            if parts == 1:
                continue
        else:
            if part >= 0:
                first[part] = i
            # where all before are one part, any link tells everything
            if parts == 1 and i and candidate(sets[i], sets[i - 1], percent) and link(i, i - 1):
                continue
            parts += 1
        if parts == 1:
            continue
        able = up.sharing(i) & down.sharing(i) & fits(np.minimum(n[:i], n[i]), np.maximum(n[:i], n[i]), percent)
        for j in np.flatnonzero(able).tolist():
            if forest.root(i) != forest.root(j):
                parts -= link(i, j)
    return out


def chained(token: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Chains, for each token, of documents or of chains of them: in order of size, each that fits what comes before it goes on with that chain.

    low and high: the least and largest size of each. Gives links of a spanning forest (a, b), and for each chain its token, a document, and its least and largest size.
    A chain stands for all its documents, since sizes between two that fit fit both."""
    order = np.lexsort((ids, high, low, token))
    token, ids, low, high = token[order], ids[order], low[order], high[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    # the largest size so far of each token, by an offset that parts tokens
    base = (np.cumsum(new) - 1) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + base) - base
    on = np.concatenate([[False], ~new[1:] & fits(np.minimum(reach[:-1], low[1:]), low[1:], percent)])
    start = np.flatnonzero(~on)
    at = np.flatnonzero(on & np.concatenate([[False], ids[1:] != ids[:-1]]))
    names, both = np.unique(np.stack([ids[at], ids[at - 1]]), return_inverse=True)
    forest = Forest(len(names))
    joined = [(i, j) for i, j in np.unique(both.reshape(2, -1), axis=1).T.tolist() if forest.join(i, j)]
    a, b = (names[[x[k] for x in joined]].astype(np.int64) for k in (0, 1))
    return a, b, token[start], ids[start], low[start], np.maximum.reduceat(high, start)


def _chains(first: DataFrame, percent: int) -> DataFrame:
    """Clusters of documents (v, component) by chains through the tokens that they list. first: id, n and prefix, a packed list of tokens."""
    shards = _shards(int((first.agg(F.sum(F.length("prefix"))).first()[0] or 0) // 8))

    def post(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chains of the batch's documents, as links in a shard below zero; and for each token and chain one document with the chain's least and largest size."""
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(2)]
        sizes = np.array([len(x) for x in lists], np.int64)
        if sizes.sum():
            n = np.repeat(b.column(1).to_numpy(), sizes)
            a, z, token, ids, low, high = chained(np.concatenate(lists), np.repeat(b.column(0).to_numpy(), sizes), n, n, percent)
            if len(a):
                none = pa.array([b""], pa.binary())
                yield batch(shard=pa.array([-1 - TaskContext.get().partitionId()], pa.int64()), token=none, id=pa.array([a.tobytes()], pa.binary()), low=pa.array([z.tobytes()], pa.binary()), high=none)
            yield dealt(_of(token, shards), token=token, id=ids, low=low, high=high)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, low = packed(pdf["id"], np.int64), packed(pdf["low"], np.int64)
        if pdf["shard"].iloc[0] < 0:
            return pd.DataFrame({"a": ids, "b": low})
        a, z, *_ = chained(packed(pdf["token"], np.uint64), ids, low, packed(pdf["high"], np.int64), percent)
        return pd.DataFrame({"a": a, "b": z})

    posted = by_arrow(first.select("id", "n", "prefix"), post, "shard long, token binary, id binary, low binary, high binary")
    return components(posted.groupBy("shard").applyInPandas(chain, "a long, b long"))


def _against_pivots(rows: DataFrame, members: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links of the documents of large clusters with pivots from outside the cluster's largest part; and id, n, component and part of the other documents.

    rows: id, n, component, part and tokens; members: id, component and in_main. A pivot has met all of its cluster and is done with. The part is that of before, else a pivot that links."""
    salt = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS))
    outside = members.where("not in_main")
    chosen = outside.groupBy("component", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("id"))
    pivots = materialize(rows.join(small(materialize(chosen.select("id")), 16), "id", "left_semi").groupBy("component").agg(F.collect_list(F.struct("id", "tokens")).alias("pivots")))
    size = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda n, p: n + F.length(p["tokens"]) + 32))).first()[0] or 0

    def compare(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, tokens, own, found = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), []
        for i, (k, pivots) in enumerate(zip(ids, own)):
            mine = np.frombuffer(tokens[i].as_py(), np.uint64)
            sets = ((p["id"], np.frombuffer(p["tokens"], np.uint64)) for p in pivots)
            found.append([j for j, other in sets if j == k or candidate(mine, other, percent) and linked(mine, other, percent)])
        yield batch(id=b.column(0), component=b.column(3), part=b.column(4), n=b.column(5), pivots=pa.array(found, pa.list_(pa.int64())))

    held = rows.join(F.broadcast(pivots) if size <= BROADCAST_BYTES else pivots, "component").select("id", "tokens", "pivots", "component", "part", "n")
    compared = materialize(by_arrow(held, compare, "id long, component long, part long, n long, pivots array<long>"))
    is_pivot = F.max(F.array_contains("pivots", F.col("id"))).alias("is_pivot")
    parts = compared.groupBy("id", "component").agg(F.sum("n").alias("n"), F.coalesce(F.min("part"), F.min(F.array_min("pivots"))).alias("part"), is_pivot)
    return compared.select(F.col("id").alias("a"), F.explode("pivots").alias("b")).where("a <> b"), parts.where("not is_pivot").drop("is_pivot")


def _mains(state: DataFrame) -> DataFrame:
    """state with in_main: whether a document is of the largest part of its cluster."""
    sizes = state.where("part is not null").groupBy("component", "part").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("component").agg(F.max(F.struct("m", "part"))["part"].alias("main"))
    return materialize(state.join(small(materialize(main), 16), "component", "left").withColumn("in_main", F.coalesce(F.col("part") == F.col("main"), F.lit(False))).drop("main"))


def _parted(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """id and component of the documents of large clusters that may still link: those that share a prefix token under an order of this turn, within their cluster. rows: id, n, component and tokens."""
    salt = mix(np.array([turn], np.uint64) + SALT)

    def prefixes(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, out = mix(b.column(3).to_numpy().astype(np.uint64) ^ SALT), []
        for i, tokens in enumerate(b.column(2)):
            rank = np.sort(mix(np.frombuffer(tokens.as_py(), np.uint64) ^ salt))
            out.append(mix(rank[: int(prefix_size(np.array(len(rank)), percent))] ^ own[i]).tobytes())
        yield batch(id=b.column(0), n=b.column(1), prefix=pa.array(out, pa.binary()))

    first = materialize(by_arrow(rows.select("id", "n", "tokens", "component"), prefixes, "id long, n long, prefix binary"))
    return _chains(first, percent).withColumnRenamed("v", "id")


def _large_clusters(sets: DataFrame, many: DataFrame, percent: int, block: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Links of large clusters that rounds of pivots found, and tasks for what is left: task, component, id, tokens and part. sets: id, n and tokens; many: id and component."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)), F.sum("n") / BLOCK_TOKENS) / block).cast("int")
    part = F.lit(None).cast("long").alias("part")
    state, found, tasks, before = many.select("id", "component", part, F.lit(False).alias("in_main")), [], [], None
    for turn in count():
        links, state = _against_pivots(sets.join(small(state, 40), "id"), state, percent, turn)
        found.append(links)
        state = _mains(state)
        outside = materialize(state.where("not in_main").groupBy("component").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m")))
        again = outside.where("blocks > 1")
        m = again.agg(F.sum("m")).first()[0] or 0
        last = not m or before is not None and 10 * m > 9 * before
        ended = state if last else state.join(small(again.select("component"), 8), "component", "left_anti")
        tasks.append(_block_pairs(sets.join(small(ended.drop("n"), 40), "id"), blocks))
        if last:
            break
        before = m
        left = state.join(small(again.select("component"), 8), "component", "left_semi").select("id", "n", "component")
        merged = components(reduce(DataFrame.unionByName, found)).select(F.col("v").alias("id"), F.col("component").alias("part"))
        left = materialize(left.join(merged, "id", "left"))
        parted = _parted(sets.join(small(left.select("id", "component"), 24), "id"), percent, turn)
        left = materialize(left.drop("component").join(small(parted, 24), "id"))
        sized = materialize(left.groupBy("component").agg(blocks.alias("blocks")))
        whole = left.join(small(sized.where("blocks = 1").select("component"), 8), "component", "left_semi").select("id", "component", "part")
        tasks.append(sets.join(small(whole, 32), "id").select((-1 - F.pmod(F.xxhash64("component"), F.lit(buckets))).alias("task"), "component", "id", "tokens", "part"))
        left = left.join(small(sized.where("blocks > 1").select("component"), 8), "component", "left_semi")
        state = _mains(left).drop("n")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, tasks)


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """The tasks of documents of large clusters: task, component, id, tokens and part. rows: id, n, tokens, component, part and in_main; blocks: into how many a group of rows is dealt.

    Documents of a cluster's largest part meet all others, not each other."""
    counts = rows.groupBy("component", "in_main").agg(blocks.alias("k"))
    dealt = counts.groupBy("component").agg(F.coalesce(F.max(F.when(F.col("in_main"), F.col("k"))), F.lit(0)).alias("mains"), F.coalesce(F.max(F.when(~F.col("in_main"), F.col("k"))), F.lit(0)).alias("others"))
    placed = rows.join(small(materialize(dealt.where("others > 0")), 16), "component")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_main = lambda other, main: F.xxhash64("component", other.cast("long"), -1 - main.cast("long"))
    of_main = F.transform(upto(F.col("others")), lambda k: with_main(k, mine))
    of_other = F.concat(
        F.transform(upto(F.col("others")), lambda k: F.xxhash64("component", F.least(k, mine).cast("long"), F.greatest(k, mine).cast("long"))),
        F.transform(upto(F.col("mains")), lambda k: with_main(mine, k)),
    )
    return placed.select(F.explode(F.when(F.col("in_main"), of_main).otherwise(of_other)).alias("task"), "component", "id", "tokens", "part")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for every row. size: words of a shingle; percent: similarity of a link."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def scan(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, one, two = [], [], []
        for s in _sets(b.column(1), size):
            n.append(len(s))
            one.append(np.sum(mix(s)).view(np.int64))
            two.append(np.sum(mix(s ^ SALT)).view(np.int64))
        yield batch(id=b.column(0), n=pa.array(n, pa.int64()), one=pa.array(one, pa.int64()), two=pa.array(two, pa.int64()))

    key = ["n", "one", "two"]
    rows = materialize(by_arrow(base, scan, "id long, n long, one long, two long"))
    classes = materialize(rows.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies")))

    # first order: how many documents a shingle is in
    parts = max(16, (rows.agg(F.sum("n")).first()[0] or 0) // SHARD_SHINGLES)
    shape = ("run", "low", "high", "doc", "often")

    def shaped(shard: pa.Array, run: int, **values: pa.Array) -> pa.RecordBatch:
        none = pa.array([b""] * len(shard), pa.binary())
        return batch(shard=shard, run=pa.array([run] * len(shard), pa.int64()), **{k: values.get(k, none) for k in shape[1:]})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each run of documents, a row with their ids and sizes, in a shard below zero; and the places of their shingles, by shard."""
        run = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi in ((i, min(i + (1 << 16), hi)) for lo, hi, _, _ in chunks(b.column(1), RUN) for i in range(lo, hi, 1 << 16)):
                sets = list(_sets(b.column(1).slice(lo, hi - lo), size))
                n = np.array([len(s) for s in sets], np.int64)
                yield shaped(pa.array([-1 - run], pa.int64()), run, low=pa.array([b.column(0).slice(lo, hi - lo).to_numpy().astype(np.int64).tobytes()], pa.binary()), high=pa.array([n.tobytes()], pa.binary()))
                if n.sum():
                    h = mix(np.concatenate(sets) + SALT)
                    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
                    found = dealt((h % np.uint64(parts)).astype(np.int64), low=(h >> np.uint64(48)).astype(np.uint16), high=(h >> np.uint64(40)).astype(np.uint8), doc=doc)
                    yield shaped(found.column(0), run, **{k: found.column(i) for i, k in enumerate(("low", "high", "doc"), 1)})
                run += 1

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        """The shingles that occur in more than one document, with how many, up to 255."""
        shard = int(pdf["shard"].iloc[0])
        if shard < 0:
            return pdf[["shard", *shape]]
        place = (packed(pdf["high"], np.uint8).astype(np.uint32) << np.uint32(16)) | packed(pdf["low"], np.uint16)
        _, where, often = np.unique(place, return_inverse=True, return_counts=True)
        often, doc = np.minimum(often, 255).astype(np.uint8)[where], packed(pdf["doc"], np.uint16)
        edges, out = np.cumsum([0, *(len(x) for x in pdf["high"])]), []
        for run, i, j in zip(pdf["run"], edges, edges[1:]):
            again = np.flatnonzero(often[i:j] > 1) + i
            if len(again):
                out.append((shard, run, (place[again] & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), (place[again] >> np.uint32(16)).astype(np.uint8).tobytes(), doc[again].tobytes(), often[again].tobytes()))
        return pd.DataFrame(out, columns=["shard", *shape])

    def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a run's documents, the prefix shingles that other documents have."""
        head = pdf["shard"] < 0
        ids, n = packed(pdf.loc[head, "low"], np.int64), packed(pdf.loc[head, "high"], np.int64)
        told = pdf[~head]
        doc, often = packed(told["doc"], np.uint16).astype(np.int64), packed(told["often"], np.uint8)
        shard = np.repeat(told["shard"].to_numpy(np.uint64), [len(x) for x in told["often"]])
        token = (shard << np.uint64(24)) | (packed(told["high"], np.uint8).astype(np.uint64) << np.uint64(16)) | packed(told["low"], np.uint16)
        alone = n - np.bincount(doc, minlength=len(n))
        want = np.maximum(0, prefix_size(n, percent) - alone)
        order = np.lexsort((mix(token), often, doc))
        doc, token = doc[order], token[order]
        taken = np.arange(len(doc)) - np.searchsorted(doc, doc) < want[doc]
        edges = np.searchsorted(doc[taken], np.arange(len(n) + 1))
        full = np.flatnonzero(np.diff(edges))
        return pd.DataFrame({"id": ids[full], "n": n[full], "prefix": [token[taken][edges[k] : edges[k + 1]].tobytes() for k in full]})

    asked = base.where("id is not null").mapInArrow(ask, "shard long, run long, low binary, high binary, doc binary, often binary")
    told = asked.groupBy("shard").applyInPandas(tell, "shard long, run long, low binary, high binary, doc binary, often binary")
    first = materialize(told.groupBy("run").applyInPandas(prefixes, "id long, n long, prefix binary"))
    first = first.join(small(classes.select(F.col("cid").alias("id")), 16), "id", "left_semi")
    clusters = _chains(first, percent)

    # second and third order
    def whole(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = list(_sets(b.column(1), size))
        yield batch(id=b.column(0), n=pa.array([len(s) for s in sets], pa.int64()), tokens=pa.array([s.tobytes() for s in sets], pa.binary()))

    named = clusters.withColumnRenamed("v", "id")
    sets = materialize(by_arrow(base.join(small(named.select("id"), 16), "id", "left_semi"), whole, "id long, n long, tokens binary"))
    values = int(sets.agg(F.sum("n")).first()[0] or 0)

    # verification: small clusters share a task, large ones are held against pivots, and what is left is dealt into pairs of blocks
    of = sets.select("id", "n").join(small(named, 32), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)), F.sum("n") / BLOCK_TOKENS) / block).cast("int")
    sized = materialize(of.groupBy("component").agg(blocks.alias("blocks")))
    buckets = max(16, values // SHARD_VALUES)
    few = named.join(small(sized.where("blocks = 1").select("component"), 16), "component")
    task = F.pmod(F.xxhash64("component"), F.lit(buckets))
    ready = sets.join(small(few, 24), "id").select(task.alias("task"), "component", "id", "tokens", F.lit(None).cast("long").alias("part"))
    found = None
    if not sized.where("blocks > 1").isEmpty():
        many = materialize(named.join(small(sized.where("blocks > 1").select("component"), 16), "component"))
        found, rest = _large_clusters(sets, many, percent, block, buckets)
        ready = ready.unionByName(rest)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.drop_duplicates(["component", "id", "tokens"]).groupby("component"):
            ids = part["id"].to_numpy()
            for i, j in links([np.frombuffer(x, np.uint64) for x in part["tokens"]], percent, pd.factorize(part["part"])[0].tolist()) if len(ids) > 1 else ():
                a.append(ids[i])
                b.append(ids[j])
        return pd.DataFrame({"a": a, "b": b}, dtype=np.int64)

    verified = ready.groupBy("task").applyInPandas(verify, "a long, b long")
    found = components(verified if found is None else verified.unionByName(found)).withColumnRenamed("v", "cid")
    groups = classes.select(*key, "cid", "copies").join(small(found, 24), "cid", "left")
    groups = materialize(groups.where("copies > 1 or component is not null").select(*key, F.coalesce("component", "cid").alias("component")))
    return rows.select("id", *key).join(small(groups, 48), key, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
