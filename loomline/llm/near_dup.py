"""Near-duplicates by a chosen-path set similarity join.

1. Every text becomes its set of word shingles (64-bit hashes), that set's digest, its size and ``POSITIONS`` minwise tokens.
   Texts of one digest are one class, represented by the smallest id; copies are never paired.
2. ``trees`` independent trees branch the classes by chosen minwise tokens: by one, and where a node still holds more
   than ``small`` classes by a second and a third. A pair of similarity s shares a node of depth d in at least one tree with
   probability 1 - (1 - s^d)^trees; 16 trees lose a pair at s = 0.85 with odds of 7e-14, 1e-9 and 4e-7 for d = 1, 2, 3, and
   at s = 0.8 with 7e-12, 8e-8 and 1e-5.
3. Nodes are compared exhaustively, first by sizes and minwise tokens: a pair stays possible unless its mismatches have
   odds under 1e-8 at the threshold. A node hands on a spanning forest of what is possible, never pairs; the forests of all
   nodes make clusters, and every link that the trees can find lies in one.
4. The classes of a cluster bring their full sets and are compared exhaustively on these; again a forest of confirmed
   links comes out. Clusters of more than ``block`` classes (or ``volume`` shingles) are compared node by node.
5. The links' components are found by alternating large and small stars.

Groups (nodes or clusters) over ``block`` classes or ``volume`` shingles: all members are compared with the group's smallest
and its largest id, and what these links tie together is a component whose members need no more looking at. The rest is cut
into blocks, components of more than a block into blocks of their own, and each pair of blocks that aren't of one component
is one comparison. So a component of any size costs as much as its blocks have strangers; what stays quadratic are the
comparisons of a large group whose texts aren't linked, spread over tasks of two blocks each.

Skew: copies are aggregated before anything is joined; hot nodes and ids occur only as keys of partial aggregates and of
joins that the engine can split; Python sees two blocks at a time and hands on at most one row for each row it gets.
Nothing but counts comes to the driver. Ids are broadcast only if counted to be at most ``BROADCAST_IDS`` (16 MB).

Defined results: texts without words (null, empty) have an empty set and are linked with nothing; a row with a null id
gets a null component and stays; a row is judged by its own text, also where ids repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import staged
from loomline.operators.graph import components

POSITIONS = 64
DEPTH = 3
BROADCAST_IDS = 2_000_000
_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; documents are linked if 100 * shared >= percent * united."""

    words: int = 5
    percent: int = 80
    trees: int = 16
    small: int = 64
    block: int = 1024
    volume: int = 4_000_000

    @property
    def least_matches(self) -> int:
        """Six standard deviations under the expected number of equal minwise tokens at the threshold."""
        s = self.percent / 100
        return max(1, int(POSITIONS * s - 6 * (POSITIONS * s * (1 - s)) ** 0.5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set of the text's shingles: hashes of ``k`` words, of all words where there are fewer, none without words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def minwise(sets: np.ndarray) -> np.ndarray:
    """The high halves of the smallest values under each multiplier."""
    out = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for lo in range(0, len(sets), 4096):
        out = np.minimum(out, (sets[lo : lo + 4096, None] * _MULTIPLIERS).min(axis=0))
    return (out >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame, like: Similarity) -> DataFrame:
    """``doc_id, n`` (size of the set), ``digest`` and ``mins`` (the minwise tokens)."""
    k = like.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), k)
                rows.append((len(found), xxh3_128_digest(found.tobytes()), minwise(found).tobytes()) if len(found) else (0, None, None))
            n, digest, mins = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(mins, pa.binary())], names=["doc_id", "n", "digest", "mins"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, mins binary")


def _paths(classes: DataFrame, like: Similarity) -> DataFrame:
    """``rep, p1, p2, p3``: for each tree the nodes of a class at each depth."""
    part = lambda t, d: F.substring("mins", (DEPTH * t + d) % POSITIONS * 4 + 1, 4)
    trees = F.array(*[F.struct(*[F.xxhash64(F.lit(t), *[part(t, d) for d in range(depth + 1)]).alias(f"p{depth + 1}") for depth in range(DEPTH)]) for t in range(like.trees)])
    return classes.select("rep", F.explode(trees).alias("path")).select("rep", "path.*")


def _nodes(classes: DataFrame, like: Similarity) -> DataFrame:
    """``group, rep`` for all nodes that aren't branched further and hold two classes or more."""
    rows, out = _paths(classes, like), None
    for depth in range(1, DEPTH + 1):
        p = f"p{depth}"
        sized = rows.join(rows.groupBy(p).agg(F.count("*").alias("size")).where("size > 1"), p)
        if depth < DEPTH:
            sized = staged(sized, "paths")
        leaf = sized.where(F.col("size") <= like.small) if depth < DEPTH else sized
        leaf = leaf.select(F.col(p).alias("group"), "rep")
        out = leaf if out is None else out.union(leaf)
        rows = sized.where(F.col("size") > like.small).drop("size")
    return staged(out, "nodes")


class Sketches:
    """Compares by sizes and minwise tokens; ``data`` is the minwise tokens."""

    def __init__(self, like: Similarity):
        self.percent, self.least = like.percent, like.least_matches

    def pairs(self, a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(d), "<u4").reshape(-1, POSITIONS) for d in (a, b))
        return (100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)) & ((x == y).sum(axis=1) >= self.least)

    def near(self, data: list[bytes], n: np.ndarray, cross: np.ndarray | None) -> Callable[[int, np.ndarray], np.ndarray]:
        mins, percent, least = np.frombuffer(b"".join(data), "<u4").reshape(-1, POSITIONS), self.percent, self.least

        def near(i: int, at: np.ndarray) -> np.ndarray:
            at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
            return at[(mins[at] == mins[i]).sum(axis=1) >= least]

        return near


class Sets:
    """Compares full sets; ``data`` is the sorted shingles."""

    RARE, COLUMNS = 8, 4096

    def __init__(self, like: Similarity):
        self.percent = like.percent

    def pairs(self, a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        shared = np.array([len(x := np.frombuffer(p, "<u8")) + len(y := np.frombuffer(q, "<u8")) - len(np.union1d(x, y)) for p, q in zip(a, b, strict=True)], np.int64)
        return 100 * shared >= self.percent * (n_a + n_b - shared)

    def shared(self, data: list[bytes]) -> np.ndarray:
        """The sizes of all intersections: shingles of few texts are counted by pairs of these, others by a matrix product."""
        m = len(data)
        values = np.frombuffer(b"".join(data), "<u8")
        owner = np.repeat(np.arange(m), [len(d) // 8 for d in data])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        count = np.diff(np.append(first, len(values)))
        out = np.zeros((m, m), np.float32)
        for d in range(2, self.RARE + 1):
            at = first[count == d][:, None] + np.arange(d)
            for lo in range(0, len(at), 50_000):
                rows = owner[at[lo : lo + 50_000]]
                pairs = np.concatenate([rows[:, i] * m + rows[:, j] for i in range(d) for j in range(i + 1, d)])
                out += np.bincount(pairs, minlength=m * m).reshape(m, m)
        out += out.T
        often = np.flatnonzero(count > self.RARE)
        for lo in range(0, len(often), self.COLUMNS):
            part = often[lo : lo + self.COLUMNS]
            column = np.repeat(np.arange(len(part)), count[part])
            at = np.repeat(first[part] - np.cumsum(count[part]) + count[part], count[part]) + np.arange(count[part].sum())
            x = np.zeros((m, len(part)), np.float32)
            x[owner[at], column] = 1
            out += x @ x.T
        return out.astype(np.int64)  # exact: counts under 2^24

    def near(self, data: list[bytes], n: np.ndarray, cross: np.ndarray | None) -> Callable[[int, np.ndarray], np.ndarray]:
        if len(data) == 2:
            linked = np.zeros((2, 2), bool)
            linked[0, 1] = linked[1, 0] = self.pairs(data[:1], data[1:], n[:1], n[1:])[0]
        else:
            shared = self.shared(data)
            linked = 100 * shared >= self.percent * (n[:, None] + n - shared)
        return lambda i, at: at[linked[i, at]]


def forest(root: np.ndarray, cross: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that tie together what ``near`` does, beyond what has one ``root``: fewer than there are roots.
    With ``cross``, only rows where it differs are compared."""
    waiting = np.ones(len(root), bool)
    out = []
    for start in range(len(root)):
        if not waiting[start]:
            continue
        queue = np.flatnonzero(waiting & (root == root[start])).tolist()
        waiting[queue] = False
        while queue:
            i = queue.pop()
            at = np.flatnonzero(waiting if cross is None else waiting & (cross != cross[i]))
            if not len(at):
                if cross is None:
                    break
                continue
            hit = near(i, at)
            if len(hit):
                new, first = np.unique(root[hit], return_index=True)
                out += [(i, j) for j in hit[first].tolist()]
                more = np.flatnonzero(waiting & np.isin(root, new))
                waiting[more] = False
                queue += more.tolist()
    return out


def _linked_pairs(pairs: DataFrame, payload: DataFrame, by: Sketches | Sets) -> DataFrame:
    """The pairs ``a < b`` that ``by`` finds near."""
    for x in ("a", "b"):
        pairs = pairs.join(payload.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("data").alias(f"data_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(f"data_{x}").to_pylist() for x in "ab")
                n_a, n_b = (batch.column(f"n_{x}").to_numpy() for x in "ab")
                yield batch.select(["a", "b"]).filter(pa.array(by.pairs(a, b, n_a, n_b)))

    return pairs.select("a", "b", "n_a", "n_b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def _rooted(large: DataFrame, payload: DataFrame, by: Sketches | Sets) -> tuple[DataFrame, DataFrame]:
    """The links of large groups' members with the group's ends, and ``group, rep, root`` by what these tie together."""
    ends = large.groupBy("group").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    tied = large.join(ends, "group")
    stars = tied.select(F.col("lo").alias("a"), F.col("rep").alias("b")).union(tied.select(F.col("rep").alias("a"), F.col("hi").alias("b")))
    links = staged(_linked_pairs(stars.where("a < b").distinct(), payload, by), "stars")
    rooted = large.join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
    return links, staged(rooted.select("group", "rep", "volume", F.coalesce("root", "rep").alias("root")), "rooted")


def _blocks(rooted: DataFrame, like: Similarity) -> DataFrame:
    """``key, cross, rep, root``: every row of a large group once for each comparison of two blocks that it takes part in.

    Components that fill a block have blocks of their own, all others of a group share theirs. Block numbers run over the
    shared ones first; a group's list of large components is as short as their sizes are large.
    """
    fill = lambda rows, volume: F.greatest(F.ceil(rows / F.lit(like.block)), F.ceil(volume / F.lit(like.volume)))
    per_root = rooted.groupBy("group", "root").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))
    own = fill(F.col("rows"), F.col("volume"))
    full = (F.col("rows") >= like.block) | (F.col("volume") >= like.volume)
    layout = per_root.groupBy("group").agg(
        F.collect_list(F.when(full, F.struct("root", own.cast("int").alias("n")))).alias("full"),
        fill(F.coalesce(F.sum(F.when(~full, F.col("rows"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("volume"))), F.lit(0))).cast("int").alias("shared"),
        F.count("*").alias("roots"),
    )
    rows = rooted.join(layout.where("roots > 1"), "group")
    mine = F.array_position(F.transform("full", lambda x: x["root"]), F.col("root")).cast("int")  # 0: in shared blocks
    before = F.col("shared") + F.aggregate(F.slice("full", F.lit(1), F.greatest(F.col("mine") - 1, F.lit(0))), F.lit(0), lambda s, x: s + x["n"])
    width = F.when(F.col("mine") > 0, F.try_element_at(F.col("full"), F.greatest(F.col("mine"), F.lit(1)))["n"]).otherwise(F.col("shared"))
    rows = rows.withColumn("mine", mine)
    rows = rows.withColumns({"first": F.when(F.col("mine") > 0, before).otherwise(F.lit(0)), "width": width, "all": F.col("shared") + F.aggregate("full", F.lit(0), lambda s, x: s + x["n"])})
    rows = rows.withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("width")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: (F.col("mine") == 0) | (x < F.col("first")) | (x >= F.col("first") + F.col("width")))
    rows = rows.select("group", "rep", "root", "block", F.explode(others).alias("other"))
    key = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(key.alias("key"), F.when(F.col("block") != F.col("other"), F.col("block") < F.col("other")).alias("cross"), "rep", "root")


def _forests(groups: DataFrame, payload: DataFrame, by: Sketches | Sets, like: Similarity) -> DataFrame:
    """Links ``a, b`` of groups' (``group, rep``) members: each group's links have the components that all its near pairs have."""
    rows = groups.join(payload.select("rep", F.col("n").alias("volume")), "rep") if isinstance(by, Sets) else groups.withColumn("volume", F.lit(0))
    sizes = rows.groupBy("group").agg(F.count("*").alias("rows"), F.sum("volume").alias("all"))
    large = staged(sizes.where((F.col("rows") > like.block) | (F.col("all") > like.volume)).select("group"), "large")
    links = None
    if large.isEmpty():
        keyed = groups.select(F.col("group").alias("key"), F.lit(None).cast("boolean").alias("cross"), "rep", F.col("rep").alias("root"))
    else:
        ids = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
        links, rooted = _rooted(rows.join(ids, "group", "left_semi"), payload, by)
        small = rows.join(ids, "group", "left_anti").select(F.col("group").alias("key"), F.lit(None).cast("boolean").alias("cross"), "rep", F.col("rep").alias("root"))
        keyed = small.union(_blocks(rooted, like))
    keyed = keyed.join(payload.select("rep", "n", "data"), "rep").select("key", "cross", "rep", "root", "n", "data")
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def compare(rows: pa.Table) -> Iterator[tuple[int, int]]:
        rep = rows.column("rep").to_numpy()
        if rows.num_rows == 2 and rep[0] == rep[1]:
            return
        cross = None if rows.column("cross").null_count else rows.column("cross").to_numpy()
        near = by.near(rows.column("data").to_pylist(), rows.column("n").to_numpy(), cross)
        for i, j in forest(rows.column("root").to_numpy(), cross, near):
            if rep[i] != rep[j]:
                yield int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))

    def twos(rows: pa.Table, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Groups of two, all at once."""
        a, b = rows.take(first), rows.take(first + 1)
        hit = by.pairs(a.column("data").to_pylist(), b.column("data").to_pylist(), a.column("n").to_numpy(), b.column("n").to_numpy())
        x, y = a.column("rep").to_numpy()[hit], b.column("rep").to_numpy()[hit]
        yield from zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)

    def done(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        first, size = np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
        found = list(twos(rows, first[size == 2])) if (size == 2).any() else []
        for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += compare(rows.slice(lo, n))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = rows.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(ends):
                yield done(rows, ends)
            rest = rows.slice(int(ends[-1]) if len(ends) else 0)
        if rest is not None:
            yield done(rest, np.array([rest.num_rows]))

    found = keyed.mapInArrow(run, "a long, b long").where("a < b").distinct()
    return found if links is None else found.union(links)


def _sets(docs: DataFrame, ids: DataFrame, like: Similarity) -> DataFrame:
    """``rep, n, data``: the full sets of some documents."""
    ids = ids.select(F.col("rep").alias("doc_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("doc_id", "text")
    k = like.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t.as_py(), k) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "data"])

    return rows.mapInArrow(run, "rep long, n long, data binary").where("n > 0")


def near_duplicates(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, kept``."""
    all_ = staged(sketches(docs, like), "sketches")
    real = all_.where("n > 0 and doc_id is not null")
    classes = staged(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins")), "classes")
    nodes = _nodes(classes, like)
    possible = staged(_forests(nodes, classes.select("rep", "n", F.col("mins").alias("data")), Sketches(like), like), "possible")
    clusters = staged(components(possible).select(F.col("id").alias("rep"), F.col("root").alias("cluster")), "clusters")
    sets = staged(_sets(docs, clusters, like), "sets")
    sizes = clusters.join(sets.select("rep", "n"), "rep").groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    big = staged(sizes.where((F.col("rows") > like.block) | (F.col("all") > like.volume)).select("cluster"), "big")
    few = big.count() <= BROADCAST_IDS
    groups = clusters.join(F.broadcast(big) if few else big, "cluster", "left_anti").select(F.col("cluster").alias("group"), "rep")
    if not big.isEmpty():
        inside = clusters.join(F.broadcast(big) if few else big, "cluster", "left_semi")
        groups = groups.union(nodes.join(inside, "rep").select(F.xxhash64("group", "cluster").alias("group"), "rep"))
    roots = components(staged(_forests(groups, sets, Sets(like), like), "links"))
    named = all_.select("doc_id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
    named = named.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (of rows that share an id, one)."""
    found = staged(near_duplicates(docs, like), "found")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    rest = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1")
    if again.isEmpty():
        return rest
    again = staged(again.select("doc_id"), "again")
    ids = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    first = rest.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(ids, "doc_id", "left_anti").unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])
