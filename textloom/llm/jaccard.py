"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), to components.

A document's set holds its distinct five-word shingles.  Documents with equal
sets are one class, kept by its smallest id.  Between classes:

1. Shingles are ranked rarest first (power of two of their class count, then
   hash).  Two sets that reach the threshold share one of the first
   n - ceil(t n) + 1 shingles of both, so only those are posted, and only where
   another class has them too.
2. An inverted list of at most ``SHORT_LIST`` classes names all pairs whose sizes
   and ranks allow the overlap.  A longer list names stars around middle sizes.
3. The set of one side of a named pair goes to the cell of the other, which holds an
   inverted index of its own sets.  A T-occurrence search merges the short lists,
   probes the long ones by binary search and keeps sets that reach the overlap.
4. Long lists whose members are in one component are done.  In the others, what is
   outside the largest component is searched for beside a few of its members, twice; then the
   sets that are left meet in blocks, where each is searched for among those that sizes and ranks
   allow, so no link between components is lost and a block emits fewer links than it has sets.

Defined cases: null and empty texts and texts without words have an empty set and
link with nothing; fewer than five words are one shingle; rows with one id are one node of
the graph, each row keeping its own set size; a null id has a null component; texts of any length are read whole; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.cells import (
    MESSAGE_DDL, answered, ask, bucket_of, cell_of, group_counts, heard, in_cells, messages, split_by, store,
)
from textloom.llm.components import components
from textloom.llm.words import BLANKS, Words, grams, whole

SIZE = 5
#: Lists up to this length name all their pairs at once; longer ones go by stars first.
SHORT_LIST = 16
#: Turns in which the rest of a long list is tied to so many members of its largest component, before all that is left.
STAR_TURNS, STAR_CENTERS = 2, 8
#: Members and shingles of one block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row (lower-cased ASCII, blank-separated words)."""
    words = Words(column, BLANKS, fold=True)
    hashes = grams(words.h, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            out.append(np.array([whole(words.h[a:b])] if b > a else [], np.uint64))
    return out


def needed(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int):
    """Least overlap of sets of n and m shingles whose Jaccard index is num / den or more."""
    return -(-(n + m) * num // (num + den))


def t_occurrence(query: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, num: int, den: int):
    """Numbers of the indexed sets that reach the overlap with ``query`` (DivideSkip).

    ``index``: sorted shingles, cuts of their lists and the lists, each in rising order.
    """
    shingles, cuts, lists = index
    at = np.searchsorted(shingles, query)
    at = at[shingles[np.minimum(at, len(shingles) - 1)] == query] if len(shingles) else at[:0]
    least = -(-len(query) * num // den)
    if len(at) < least:
        return np.zeros(0, np.int64)
    lengths = cuts[at + 1] - cuts[at]
    at = at[np.argsort(lengths, kind="stable")]
    longest = int(lengths.max())
    skipped = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1))) if longest > 8 else 0
    short, long_ = at[: len(at) - skipped], at[len(at) - skipped :]
    merged = lists[_ranges(cuts[short], cuts[short + 1])]
    if len(merged) * 4 > len(sizes):
        count = np.bincount(merged, minlength=len(sizes))
        found = np.flatnonzero(count >= least - skipped)
        count = count[found]
    else:
        found, count = np.unique(merged, return_counts=True)
        keep = count >= least - skipped
        found, count = found[keep], count[keep]
    for s in long_.tolist():
        own = lists[cuts[s] : cuts[s + 1]]
        spot = np.minimum(np.searchsorted(own, found), len(own) - 1)
        count = count + (own[spot] == found)
    return found[count >= needed(len(query), sizes[found], num, den)]


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sizes = stops - starts
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))


def build_index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    shingles, first = np.unique(h[order], return_index=True)
    return shingles, np.r_[first, len(h)], owner[order]


_POST = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rank", "<i4")])


def _allowed(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of postings of one list whose sizes and ranks leave room for the overlap."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    left = np.minimum(n - x["rank"], m - y["rank"])
    return (x["node"] != y["node"]) & (left >= needed(n, m, num, den)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)


def _named_pairs(posts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs named by the lists of a bucket, and the postings of its long lists."""
    posts = np.sort(posts, order=["h", "n", "node"])
    _, first, size = np.unique(posts["h"], return_index=True, return_counts=True)
    short = np.repeat(size <= SHORT_LIST, size)
    pairs = [np.zeros((0, 2), np.int64)]
    few = posts[short]
    for step in range(1, SHORT_LIST):
        x, y = few[:-step], few[step:]
        ok = (x["h"] == y["h"]) if len(x) else np.zeros(0, bool)
        if not ok.any():
            break
        x, y = x[ok], y[ok]
        ok = _allowed(x, y, num, den)
        pairs.append(np.stack([x["node"][ok], y["node"][ok]], 1))
    for a, b in zip(first[size > SHORT_LIST].tolist(), (first + size)[size > SHORT_LIST].tolist()):
        open_ = [(a, b)]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < 2:
                continue
            own = posts[lo:hi]
            center = own[(hi - lo) // 2]
            n = own["n"].astype(np.int64)
            near = np.flatnonzero(np.minimum(n, n[(hi - lo) // 2]) * den >= np.maximum(n, n[(hi - lo) // 2]) * num)
            ok = own[near][_allowed(own[near], np.broadcast_to(center, len(near)), num, den)]
            pairs.append(np.stack([np.full(len(ok), center["node"]), ok["node"]], 1))
            open_ += [(lo, lo + int(near[0])), (lo + int(near[-1]) + 1, hi)]
    out = np.concatenate(pairs)
    out = np.unique(np.sort(out, 1), axis=0) if len(out) else out
    return out[:, 0], out[:, 1], posts[~short]


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 75, den: int = 100, size: int = SIZE,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = [], []
            for own in shingle_sets(batch.column(1), size):
                n.append(len(own))
                parts.append(xxhash.xxh3_128_digest(own.tobytes()))
            both = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "n", "d1", "d2"]
            )

    rows = store(given.mapInArrow(digest, "id long, n long, d1 long, d2 long"), "sets")
    count, buckets = group_counts(6 * (rows.agg(F.sum("n")).first()[0] or 0))  # a shingle begins every six bytes or so
    classes = rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    classes = store(classes, "classes")
    texts = in_cells(given.where("id is not null"), count, "id")
    reps = classes.select(F.lit(0).alias("to"), cell_of(count, "rep").alias("cell"), F.lit(-1).alias("kind"), _packed("rep"))

    def known(left: pa.Table, right: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        """Ids and sets of the rows of a cell that are named as their class."""
        own = [int.from_bytes(d, "big", signed=True) for d, k in zip(right["data"].to_pylist(), right["kind"].to_pylist()) if k == -1]
        left = left.filter(pa.compute.is_in(left["id"], pa.array(own, pa.int64())))
        sets, ids, seen = [], [], set()
        for doc, s in zip(left["id"].to_pylist(), shingle_sets(left["t"], size)):
            if len(s) and (mark := (doc, s.tobytes())) not in seen:
                seen.add(mark)
                ids.append(doc)
                sets.append(s)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], sets[i].tobytes()))
        return [ids[i] for i in order], [sets[i] for i in order]

    def cell_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        short = (bucket_of(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & _LOW)
        keys, at, held = np.unique(short, return_inverse=True, return_counts=True)
        present, first = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
        return keys, at, held, present, np.r_[first, len(keys)]

    def tell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, held, present, cuts = cell_keys(known(left, right)[1])
        low, held = (keys & _LOW).astype("<u4"), np.minimum(held, 255).astype("u1")
        return messages(present, key[0].as_py(), 0, [low[a:b].tobytes() + held[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    def rarity(group: pa.Table) -> pa.Table:
        data = group["data"].to_pylist()
        sizes = [len(d) // 5 for d in data]
        low = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(data, sizes)])
        held = np.concatenate([np.frombuffer(d, "u1", n, 4 * n) for d, n in zip(data, sizes)])
        _, at = np.unique(low, return_inverse=True)
        total = np.bincount(at, held)[at]
        power = np.floor(np.log2(total)).astype("u1")
        power[total > 1] += 1
        return messages(
            group["to"].to_numpy(), group["cell"].to_numpy(), 0, [p.tobytes() for p in np.split(power, np.cumsum(sizes)[:-1])]
        )

    powers = store(ask(heard(texts, reps, tell, MESSAGE_DDL), rarity), "rarity").unionByName(reps)

    def post(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sets = known(left, right)
        if not ids:
            return messages(np.zeros(0), key[0].as_py(), 0, [])
        _, at, _, present, _ = cell_keys(sets)
        told = answered(right, 0)
        power = np.frombuffer(b"".join(told[b] for b in present.tolist()), "u1")[at]
        h = np.concatenate(sets)
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.lexsort((h, power, owner))
        rank = np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        kept = (rank < (n - -(-n * num // den) + 1)[owner]) & (power[order] > 0)
        posts = np.empty(int(kept.sum()), _POST)
        posts["h"], posts["rank"] = h[order][kept], rank[kept]
        posts["node"], posts["n"] = np.array(ids)[owner[kept]], n[owner[kept]]
        order, present, cuts = split_by(bucket_of(posts["h"], buckets))
        posts = posts[order]
        return messages(present, key[0].as_py(), 0, [posts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    def name(group: pa.Table) -> pa.Table:
        posts = np.concatenate([np.frombuffer(d, _POST) for d in group["data"].to_pylist()])
        a, b, long_ = _named_pairs(posts, num, den)
        zero = np.zeros(len(a), np.int64)
        columns = [np.r_[zero, long_["h"].view("<i8")], np.r_[a, long_["node"]], np.r_[b, long_["n"]], np.r_[zero - 1, long_["rank"]]]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["h", "a", "b", "rank"])

    named = store(ask(heard(texts, powers, post, MESSAGE_DDL), name, "h long, a long, b long, rank long"), "named")
    pairs = named.where("rank < 0").select("a", "b").distinct()
    first = _search(given, pairs, count, size, num, den).unionByName(_same_id(rows, classes))
    near = store(components(first), "near")

    members = named.where("rank >= 0").select("h", F.col("a").alias("node"), F.col("b").alias("n"), "rank")
    tried = pairs
    for turn in range(STAR_TURNS + 1):
        apart = store(_apart(members, near), "apart")
        if not apart.head(1):
            break
        if turn < STAR_TURNS:
            more = store(_stars(apart, turn, num, den).distinct().join(tried, ["a", "b"], "left_anti"), "more")
            tried = tried.unionByName(more)
            found = _search(given, more, count, size, num, den)
        else:
            sets = _gather(given, apart.select(F.col("node").alias("id")).distinct(), count, size)
            found = store(_blocks(apart, sets, num, den), "found")
        # what is known of the components is as good as the links it came from
        tied = near.where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
        near = store(components(tied.unionByName(found)), "near")
    whole_class = classes.join(near, classes["rep"] == near["node"], "left").select(
        "d1", "d2", F.coalesce("component_id", "rep").alias("component_id")
    )
    out = rows.join(whole_class, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")
    )


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: ties between the classes that one id is in."""
    held, mark = rows.where("n > 0 and id is not null"), F.struct("d1", "d2")
    several = held.groupBy("id").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("id")
    reps = held.join(several, "id").join(classes, ["d1", "d2"]).select("id", "rep").distinct()
    least = reps.groupBy("id").agg(F.min("rep").alias("b"))
    return reps.join(least, "id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _packed(column: str):
    return F.unhex(F.lpad(F.hex(column), 16, "0")).alias("data")


def _apart(members: DataFrame, near: DataFrame) -> DataFrame:
    """Members of the long lists that hold more than one component ``c``, with the list's ``size``."""
    now = members.join(near, "node", "left").withColumn("c", F.coalesce("component_id", "node")).drop("component_id")
    lists = now.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).where("x <> y")
    return now.join(lists.select("h", "size"), "h")


def _stars(apart: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Members outside the largest component of their list, beside a few members of it."""
    largest = apart.groupBy("h", "c").count().groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("top"))
    marked = apart.join(largest, "h")
    order = Window.partitionBy("h").orderBy(F.xxhash64(F.lit(turn), "node"), "node")
    inner = marked.where("c = top").withColumn("at", F.row_number().over(order)).where(F.col("at") <= STAR_CENTERS)
    inner = inner.select("h", F.col("node").alias("center"), F.col("n").alias("m"))
    sizes = F.least("n", "m") * den >= F.greatest("n", "m") * num
    tied = marked.where("c <> top").join(inner, "h").where(sizes)
    return tied.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))


def _blocks(apart: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: links that tie the components of each list together, from block pairs of bounded size.

    Lists with the same first member (in hash order), so mostly lists with the same members, are
    joined into one; each member keeps its lowest rank, so no pair that one of them allows is lost
    and a set is sent once for all of them.
    """
    first = apart.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(5), "node").alias("k"), "node")).alias("first"))
    named = apart.join(first.select("h", F.col("first.node").alias("g")), "h")
    members = store(named.groupBy("g", "node", "n", "c").agg(F.min("rank").alias("rank")), "members")
    weight = members.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    split = members.join(weight, "g").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("g", "node", "n", "rank", "c", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    held = sets.select(F.col("id").alias("node"), (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")

    def across(group: pa.Table) -> pa.Table:
        return _across(group, num, den)

    return split.join(held, ["node", "n"]).groupBy("g", "p", "q").applyInArrow(across, "a long, b long")


def _across(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links of one block pair of joined long lists: each ties two components that were still apart.

    Sizes and ranks choose what a set is searched for in; links inside a component are not looked for.
    """
    group = group.sort_by([("n", "ascending"), ("node", "ascending")])
    posts = np.empty(group.num_rows, _POST)
    for name in ("node", "n", "rank"):
        posts[name] = group[name].to_numpy()
    c, own = group["c"].to_numpy().copy(), group["own"].to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in group["shingles"].to_pylist()]
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    n = posts["n"].astype(np.int64)
    reach = np.searchsorted(n * num, n * den, side="right")
    index = build_index(sets)
    a, b = [], []
    for i in range(len(posts)):
        other = posts[i + 1 : reach[i]]
        ok = (c[i + 1 : reach[i]] != c[i]) & _allowed(other, np.broadcast_to(posts[i], len(other)), num, den)
        if p != q:
            ok &= own[i + 1 : reach[i]] != own[i]
        if not ok.any():
            continue
        found = t_occurrence(sets[i], index, n, num, den)
        found = found[(found > i) & (found < reach[i])]
        for j in found[ok[found - i - 1]]:
            if c[j] != c[i]:
                a.append(posts["node"][i])
                b.append(posts["node"][j])
                c[c == c[j]] = c[i]
    ends = np.sort(np.array([a, b], np.int64).reshape(2, -1), 0)
    return pa.table([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])


def _gather(given: DataFrame, ids: DataFrame, count: int, size: int) -> DataFrame:
    """``cell, id, shingles``: the distinct sets of the rows with these ids; only their texts are dealt out."""
    wanted = given.join(ids, "id", "left_semi").select(cell_of(count, "id").alias("cell"), "id", "t").repartition("cell")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = shingle_sets(batch.column(2), size)
            marks = [(i, xxhash.xxh3_128_digest(s.tobytes())) for i, s in zip(batch.column(1).to_pylist(), sets)]
            new = []
            for at, (s, mark) in enumerate(zip(sets, marks)):
                if len(s) and mark not in seen:
                    seen.add(mark)
                    new.append(at)
            own = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array([sets[at].tobytes() for at in new], pa.binary())], names=["cell", "id", "shingles"]
            )

    return store(wanted.mapInArrow(gather, "cell int, id long, shingles binary"), "sets")


def _search(given: DataFrame, pairs: DataFrame, count: int, size: int, num: int, den: int) -> DataFrame:
    """``a, b``: links found by sending the set of the first of each pair to the cell of the second."""
    pairs = store(pairs, "pairs")
    sets = _gather(given, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), count, size)
    wanted = pairs.select(F.col("a").alias("id"), cell_of(count, "b").alias("cell")).distinct()
    asker = sets.select(F.col("id").alias("query"), F.col("shingles").alias("asked"))
    queries = wanted.join(asker, wanted["id"] == asker["query"]).select("cell", "query", "asked")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, "<u8") for s in left["shingles"].to_pylist()]
        ids, sizes, index = left["id"].to_numpy(), np.array([len(s) for s in sets], np.int64), build_index(sets)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for query, s in zip(right["query"].to_pylist(), right["asked"].to_pylist()):
            found = ids[t_occurrence(np.frombuffer(s, "<u8"), index, sizes, num, den)]
            found = found[found != query]
            a.append(np.full(len(found), query, np.int64))
            b.append(found)
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return store(heard(sets.repartition("cell"), queries, search, "a long, b long"), "links")
