"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import flat_graph as graph
from tallyloom.llm.common import checkpoint, named, steps
from tallyloom.llm.components import connected_components

#: Vectors that a shard should hold and shards of a cluster that a vector is put into; a cluster of more than twice the
#: first is cut again.
SHARD, OVERLAP = 2000, 2
#: Clusters that one is cut into at once, vectors for each that their centres are fitted on, and the deepest cut; what is
#: larger even then (vectors in one direction) is cut by a digest.
CHILDREN, SAMPLE, DEEPEST = 64, 32, 8
#: Vectors that one task deals to clusters, and searches from elsewhere that one task takes in.
MOST_ROUTED, MOST_GUESTS = 16_384, 4096
#: Vectors of a block that are compared with another block's at once, and pairs times shards that are looked at at once.
BLOCK, MOST_LOOKED = 1024, 1 << 22
#: Queries of the recall audit in a label, about, and the recall of a label below which it is searched anew.
MOST_AUDITED, LEAST_RECALL, ATTEMPTS = 500, 0.995, 3
#: How far single precision may be off: what a walk finds this near its bound is compared in double precision.
LOOSE = 1e-5
#: A ball's greatest angle from its leader, as a part of the threshold's. Any up to 2 is right; narrow balls leave few
#: pairs whose members have to be compared.
NARROW = 8
#: What is added to angles to leaders, many times the error of an arc cosine near 1, so that no certain link is wrong.
SURE = 1e-7
#: Kinds of rows that searches give: links counted, connected leaders, balls to compare, how many are in range of audited leaders, visits.
COUNT, STAR, BALLS, AUDITED, VISIT = range(5)
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("cell", pa.string())])
FOUND = "kind byte, a long, b long, n long, cell string"


def unit(vectors: np.ndarray | list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    out = np.array(vectors, np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """The unit vectors of a column of lists of one length."""
    return unit(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1))


def _usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _share(seed: int, key: str) -> Column:
    """A number in [0, 1) from a digest."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)


# -- shards -----------------------------------------------------------------------------------------------------------


def _fit(table: pa.Table) -> pa.Table:
    """Centres of one cluster's sample."""
    table = table.sort_by("node")
    found = graph.centres(_matrix(table["vec"], len(table)), table["k"][0].as_py())
    return pa.table({"cell": table["cell"].slice(0, 1), "centres": pa.array([found.ravel()], pa.list_(pa.float64()))})


def _route(left: pa.Table, right: pa.Table) -> pa.Table:
    """The cluster's vectors dealt to their nearest centres: those at home to several, the others to one."""
    vectors = _matrix(left["vec"], len(left))
    centres = right["centres"].combine_chunks().flatten().to_numpy().reshape(-1, vectors.shape[1])
    home, overlap = left["home"].to_numpy(), left["overlap"][0].as_py()
    order = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :overlap]
    parent, nodes = left["cell"][0].as_py(), left["node"].to_numpy()
    rows, at = np.nonzero(home[:, None] | (np.arange(order.shape[1]) == 0))
    cells = [f"{k}/{parent}" for k in order[rows, at]]
    return pa.table({"node": nodes[rows], "grp": left["grp"].take(pa.array(rows)), "cell": pa.array(cells, pa.string()), "home": home[rows] & (at == 0)})


def shards(nodes: DataFrame, shard: int, overlap: int) -> DataFrame:
    """(node, grp, cell, home): each vector's shards, one of which is its home.

    Clusters are cut until none holds more than ``2 * shard`` rows, CHILDREN at a time, in every label alike. Centres
    are fitted in tasks on a bounded sample of each cluster, and vectors are dealt in tasks of a bounded size, so no
    step depends on how many or how large the labels are. At each cut a vector at home goes to its ``overlap`` nearest
    clusters and is at home in the nearest; a vector elsewhere goes on to one.
    """
    placed = nodes.select("node", "grp", F.concat(F.lit("|"), "grp").alias("cell"), F.lit(True).alias("home"))
    done = []
    for level in range(DEEPEST + 1):
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = checkpoint(sizes.where(F.col("n") > 2 * shard).withColumn("k", F.least(F.lit(CHILDREN), F.ceil(F.col("n") * overlap / shard)).cast("int")))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, placed])
        done.append(placed.join(large, "cell", "left_anti"))
        own = placed.join(large, "cell").join(nodes.select("node", "vec"), "node")
        if level == DEEPEST:
            piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / shard)).cast("string")
            return reduce(DataFrame.unionByName, [*done, own.select("node", "grp", F.concat(piece, F.lit("/"), "cell").alias("cell"), "home")])
        sample = own.where((_share(7, "node") < F.col("k") * SAMPLE / F.col("n")) | (F.col("n") <= F.col("k") * SAMPLE))
        centres = sample.select("cell", "node", "k", "vec").groupBy("cell").applyInArrow(_fit, "cell string, centres array<double>")
        parts = F.ceil(F.col("n") / MOST_ROUTED)
        spread = centres.join(large, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
        left = own.select("cell", F.pmod(F.xxhash64("node"), parts).alias("salt"), "node", "grp", "home", "vec", F.lit(overlap).alias("overlap"))
        placed = checkpoint(left.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_route, "node long, grp string, cell string, home boolean"))
    raise AssertionError


def _balls(homes: DataFrame, least: float) -> DataFrame:
    """(node, leader, away): vectors at home in a shard gathered around leaders so close that any two of a ball are linked, and their angles to these."""

    def lead(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        vectors = _matrix(table["vec"], len(table))
        own = graph.leaders(vectors, least)
        away = np.where(own == np.arange(len(own)), 0.0, np.arccos(np.minimum(1.0, np.einsum("ij,ij->i", vectors, vectors[own]))) + SURE)
        return pa.table({"node": table["node"], "leader": table["node"].to_numpy()[own], "away": away})

    return homes.select("cell", "node", "vec").groupBy("cell").applyInArrow(lead, "node long, leader long, away double")


def _bounds(threshold: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two balls whose angles from leader to rim add up to ``reach``: the cosine of the leaders from which members may be linked, and that from which all are."""
    angle, exact = np.arccos(threshold), reach == 0
    some = np.where(exact, threshold, np.cos(np.minimum(np.pi, angle + reach)) - 1e-12)
    return some, np.where(exact, threshold, np.where(reach < angle, np.cos(np.maximum(0.0, angle - reach)), np.inf))


def _lists(members: DataFrame) -> DataFrame:
    """(node, near): each leader's adjacency lists from all its shards, united."""

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids = table["node"].to_numpy()
        edges = graph.build(_matrix(table["vec"], len(table)).astype(np.float32))
        near = [ids[row[row >= 0]] for row in edges]
        return pa.table({"node": ids, "near": pa.array(near, pa.list_(pa.int64()))})

    built = members.select("cell", "node", "vec").groupBy("cell").applyInArrow(link, "node long, near array<bigint>")
    return built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


# -- searches ---------------------------------------------------------------------------------------------------------


def _rows(kind: int, a, b=None, n=None, cell=None) -> pa.RecordBatch:
    size = len(a)
    none = lambda t: pa.nulls(size, t)
    columns = [pa.array(np.full(size, kind, np.int8)), pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b, pa.int64()), none(pa.int64()) if n is None else pa.array(n, pa.int64()), none(pa.string()) if cell is None else pa.array(cell, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def _linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links among places of ``ids`` as stars around the smallest place of each connected part."""
    return _stars(ids, graph.stars(len(ids), a, b))


def _stars(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    some = np.nonzero(root != np.arange(len(ids)))[0]
    return _rows(STAR, ids[some], ids[root[some]])


def _visits(a: np.ndarray, nodes: np.ndarray, belongs: np.ndarray, this: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, node) the first for each a and shard that the node belongs to and a does not, and that shard; a slice of the pairs at a time."""
    names, keys, pairs = belongs.shape[1], np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = max(1, MOST_LOOKED // max(1, names))
    for at in range(0, len(a), most):
        away = belongs[nodes[at : at + most]] & ~belongs[a[at : at + most]]
        if this >= 0:
            away[:, this] = False
        p, code = np.nonzero(away)
        every = np.concatenate([keys, a[at + p] * names + code])
        keys, first = np.unique(every, return_index=True)
        pairs = np.concatenate([pairs, at + p])[first]
    return pairs, keys % max(1, names)


def _completed(walked: tuple[np.ndarray, np.ndarray, np.ndarray], close: np.ndarray, bound, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a walk found, and what of its shard is in range besides: an exact check of a bounded shard, so that a range whose graph falls into parts is whole.

    ``close`` has the cosines of the queries with all of the shard, ``least`` the lowest bound of each query. The walk's own
    finds stay as they are.
    """
    rows, nodes, value = walked
    left = close >= least[:, None]
    left[rows, nodes] = False
    more, at = np.nonzero(left)
    keep = close[more, at] >= bound(more, at)
    more, at = more[keep], at[keep]
    return np.concatenate([rows, more]), np.concatenate([nodes, at]), np.concatenate([value, close[more, at]])


def _searcher(threshold: float, beam: int):
    """The search of one shard, for its own leaders or for guests from other shards.

    The walk goes over the united lists, as far as they lead inside the shard, from its medoid and from the query's own
    place, or from a guest's partner. A leader so near that its whole ball is linked with the query's is counted where it
    is at home, so each pair is counted once for each side; one whose members may be linked is named. Where a leader
    in range belongs to other shards, its list leads there: the query is to visit these. What a walk leaves out of its
    shard is found by an exact check of the shard, which is bounded, so that visits lead on along everything in range.

    What TOGETHER queries find leaves the task before the next ones search, and their links are folded into stars, so
    that a dense shard, in which all are in range of all, takes no memory by its pairs.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by([("guest", "ascending"), ("node", "ascending")])
        everyone, m = table["node"].to_numpy(), len(table) - int(np.count_nonzero(table["guest"].to_numpy()))
        vectors, reach = _matrix(table["vec"], len(table)), table["reach"].to_numpy()
        ids, home, weight = everyone[:m], table["home"].to_numpy()[:m], table["weight"].to_numpy()[:m]
        asked, single_precision = table["asked"].to_numpy(), vectors.astype(np.float32)
        lists = table["near"].slice(0, m).combine_chunks()
        edges = graph.local_edges(ids, lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
        start, widest = graph.medoid(single_precision[:m]), reach[:m].max()
        edges = graph._joined(single_precision[:m], edges, start)
        queries = np.arange(m, len(table)) if m < len(table) else np.arange(m)
        entry = np.searchsorted(ids, table["entry"].slice(m).to_numpy()) if m < len(table) else queries
        names = {c: k for k, c in enumerate(sorted({c for row in table["cells"].to_pylist() for c in row}))}
        by_code, own_cells = np.array(list(names), object), [[names[c] for c in row] for row in table["cells"].to_pylist()]
        belongs = np.zeros((len(table), len(names)), bool)
        for k, row in enumerate(own_cells):
            belongs[k, row] = True
        this = names.get(table["cell"][0].as_py(), -1)
        root = np.arange(len(table))
        for at in range(0, len(queries), graph.TOGETHER):
            own = queries[at : at + graph.TOGETHER]
            bound = lambda rows, nodes, own=own: _bounds(threshold, reach[own[rows]] + reach[nodes])[0]
            starts = np.stack([np.full(len(own), start), entry[at : at + len(own)]], axis=1)
            walked = graph.walk(single_precision[:m], edges, starts, single_precision[own], lambda r, c: bound(r, c) - LOOSE, beam)
            rows, nodes, value = _completed(walked, single_precision[own] @ single_precision[:m].T, lambda r, c: bound(r, c) - LOOSE, _bounds(threshold, reach[own] + widest)[0] - LOOSE)
            some, whole = _bounds(threshold, reach[own[rows]] + reach[nodes])
            exact = value.astype(np.float64)
            unsure = np.nonzero((np.abs(exact - some) < LOOSE) | (np.abs(exact - whole) < LOOSE))[0]
            exact[unsure] = np.einsum("ij,ij->i", vectors[own[rows[unsure]]], vectors[nodes[unsure]])
            keep = (exact >= some) & (everyone[own[rows]] != ids[nodes])
            rows, nodes, one = rows[keep], nodes[keep], (exact >= whole)[keep]
            a, here = own[rows], home[nodes]
            counts = np.bincount(rows[one & here], weight[nodes[one & here]], len(own)).astype(np.int64)
            some = np.nonzero(counts)[0]
            yield _rows(COUNT, everyone[own[some]], n=counts[some])
            tied = np.nonzero(root != np.arange(len(root)))[0]
            root = graph.stars(len(root), np.concatenate([tied, a[one]]), np.concatenate([root[tied], nodes[one]]))
            ball = np.stack([everyone[a[~one]], ids[nodes[~one]]], axis=1)
            ball = np.unique(np.sort(ball, axis=1), axis=0)
            yield _rows(BALLS, ball[:, 0], ball[:, 1])
            partners = np.bincount(rows[here], minlength=len(own))
            some = np.nonzero(asked[own] & (partners > 0))[0]
            yield _rows(AUDITED, everyone[own[some]], n=partners[some])
            first, code = _visits(a, nodes, belongs, this)
            yield _rows(VISIT, everyone[a[first]], ids[nodes[first]], cell=by_code[code])
        yield _stars(everyone, root)

    return search


def _explore(members: DataFrame, heads: DataFrame, threshold: float, beam: int) -> DataFrame:
    """What the searches of all leaders of ``members`` find: first in their own shards, then, round by round, in those that partners lead to.

    No leader visits a shard twice, and a visit moves one vector. A shard's guests are split among tasks.
    """
    search, columns = _searcher(threshold, beam), ["cell", "node", "vec", "weight", "reach", "home", "asked", "cells", "near", "guest", "entry"]
    hosts = members.withColumn("guest", F.lit(False)).withColumn("entry", F.lit(None).cast("long"))
    found = [checkpoint(hosts.select(*columns).groupBy("cell").applyInArrow(search, FOUND))]
    visited = None
    while True:
        fresh = found[-1].where(F.col("kind") == VISIT).groupBy(F.col("a").alias("node"), "cell").agg(F.min("b").alias("entry"))
        fresh = checkpoint(fresh if visited is None else fresh.join(visited, ["node", "cell"], "left_anti"))
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, found).where(F.col("kind") != VISIT)
        visited = fresh.select("node", "cell") if visited is None else visited.unionByName(fresh.select("node", "cell"))
        parts = checkpoint(fresh.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MOST_GUESTS).alias("parts")))
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        here = hosts.join(parts, "cell").select(salt.alias("salt"), *columns)
        none = F.array().cast("array<bigint>").alias("near")
        guests = fresh.join(heads, "node").join(parts, "cell").select(F.pmod(F.xxhash64("node"), F.col("parts")).alias("salt"), "cell", "node", "vec", "weight", "reach", F.lit(False).alias("home"), "asked", "cells", none, F.lit(True).alias("guest"), "entry")
        found.append(checkpoint(here.unionByName(guests).groupBy("cell", "salt").applyInArrow(search, FOUND)))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows one by one, lists as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[k].as_py() for c in batch.columns]


def _blocks(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows of each key and block with their columns as arrays in one order, the vectors one after another."""
    listed = rows.groupBy(*keys, "block").agg(F.collect_list(F.struct(*columns, "vec")).alias("r"))
    return listed.select(*keys, "block", *[F.col(f"r.{c}").alias(c) for c in columns], F.flatten("r.vec").alias("vec"))


def _in_blocks(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The number of blocks of each label, and ``heads`` with their block."""
    sizes = checkpoint(heads.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    return sizes, heads.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _compare_all(heads: DataFrame, threshold: float) -> DataFrame:
    """What ``_explore`` finds, by comparing all leaders of a label without a search, block by block.

    The work grows with the square of a label's leaders, the tasks do not."""
    sizes, placed = _in_blocks(heads)
    blocks = checkpoint(_blocks(placed, ["grp"], "node", "reach", "weight"))
    end = lambda name: blocks.select("grp", F.col("block").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("node", "reach", "weight", "vec")])
    both = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("y", F.explode(F.sequence(F.col("x"), F.col("parts") - 1)))
    met = both.join(end("x"), ["grp", "x"]).join(end("y"), ["grp", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, p, q, reach, too, weigh_p, weigh_q, left, right in _batches(batches):
            close, same = unit(left.reshape(len(p), -1)) @ unit(right.reshape(len(q), -1)).T, x == y
            some, whole = _bounds(threshold, reach[:, None] + too[None, :])
            near = close >= some
            if same:
                near[np.arange(len(p)), np.arange(len(p))] = False
            linked = near & (close >= whole)
            for ids, counts in ((p, linked @ weigh_q), *([] if same else [(q, linked.T @ weigh_p)])):
                yield _rows(COUNT, ids[counts > 0], n=counts[counts > 0])
            i, j = np.nonzero(linked)
            yield _linked(p, i, j) if same else _linked(np.concatenate([p, q]), i, j + len(p))
            i, j = np.nonzero(near & ~linked)
            balls = np.unique(np.sort(np.stack([p[i], q[j]], axis=1), axis=1), axis=0)
            yield _rows(BALLS, balls[:, 0], balls[:, 1])

    columns = ["x", "y", *[f"{c}_{e}" for c in ("node", "reach", "weight", "vec") for e in ("x", "y")]]
    return checkpoint(met.select(*columns).mapInArrow(run, FOUND))


def audit(heads: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(grp, recall): by label how many of the leaders in range of its audited ones ``found(a, n)`` counts.

    The audited leaders are compared with all leaders of their label, block by block. For each that has others in range
    the share of these that was found counts; as searches compare what they find exactly, all that they count is in
    range, and counts show what is missing. Recall is the mean of the shares. A label whose audited leaders have nothing
    in range has no row. Cosines within 1e-12 of the bound are no misses.
    """
    sizes, placed = _in_blocks(heads)
    asked = _blocks(placed.where("asked").withColumn("block", F.lit(0)), ["grp"], "node", "reach").drop("block")
    asked = asked.join(sizes, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = _blocks(placed, ["grp"], "node", "reach").select("grp", "block", F.col("node").alias("node_y"), F.col("reach").alias("reach_y"), F.col("vec").alias("vec_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, p, q, reach, too, left, right in _batches(batches):
            close = unit(left.reshape(len(p), -1)) @ unit(right.reshape(len(q), -1)).T
            true = ((close >= _bounds(threshold, reach[:, None] + too[None, :])[0] + 1e-12) & (p[:, None] != q[None, :])).sum(axis=1)
            some = np.nonzero(true)[0]
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.string()), pa.array(p[some], pa.int64()), pa.array(true[some], pa.int64())], ["grp", "a", "true"])

    true = asked.join(every, ["grp", "block"]).select("grp", "node", "node_y", "reach", "reach_y", "vec", "vec_y").mapInArrow(run, "grp string, a long, true long").groupBy("grp", "a").agg(F.sum("true").alias("true"))
    held = found.groupBy("a").agg(F.sum("n").alias("held"))
    share = F.least(F.lit(1.0), F.coalesce("held", F.lit(0)) / F.col("true"))
    return checkpoint(true.join(held, "a", "left").groupBy("grp").agg(F.avg(share).alias("recall")))


def _verified(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, node, links): for each member of ball a how many vectors of ball b it is linked with, copies counted, if any.

    Members are compared block by block in double precision; only counts come out, a row for each member and block."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    block = F.floor(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))).cast("int")
    blocks = checkpoint(_blocks(members.join(pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct(), "leader").withColumn("block", block), ["leader"], "node", "mult"))
    end = lambda name: blocks.select(F.col("leader").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("node", "mult", "vec")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, nodes, weights, left, right in _batches(batches):
            near = unit(left.reshape(len(nodes), -1)) @ unit(right.reshape(len(weights), -1)).T >= threshold
            counts = near @ weights
            some = np.nonzero(counts)[0]
            arrays = [np.full(len(some), x), np.full(len(some), y), nodes[some], counts[some]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in arrays], ["a", "b", "node", "links"])

    met = ends.join(end("a"), "a").join(end("b"), "b").select("a", "b", "node_a", "mult_b", "vec_a", "vec_b")
    return checkpoint(met.mapInArrow(run, "a long, b long, node long, links long"))


# -- the operator -----------------------------------------------------------------------------------------------------


def _tried(nodes: DataFrame, threshold: float, shard: int, overlap: int, beam: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One attempt: what was found, the members of all balls, and the audited recall by label.

    With ``last``, labels that the search leaves below LEAST_RECALL are compared in full; their recall is 1 then."""
    tight = float(np.cos(np.arccos(threshold) / NARROW)) + 1e-12
    placed = checkpoint(shards(nodes, shard, overlap))
    led = checkpoint(_balls(placed.where("home").join(nodes.select("node", "vec"), "node"), tight))
    every = nodes.select("node", "grp", "mult", "vec").join(led, "node")
    balls = every.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("mult").alias("ball"), F.max("away").alias("reach"))
    members = checkpoint(every.join(balls, "leader"))
    cells = placed.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    heads = members.where("node = leader").select("node", "grp", F.col("ball").alias("weight"), "vec", "reach")
    many = heads.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    heads = checkpoint(heads.join(cells, "node").join(many, "grp").withColumn("asked", _share(11, "node") < MOST_AUDITED / F.col("n")).drop("n"))
    own = placed.select("node", "cell", "home").join(heads, "node")
    lists = checkpoint(_lists(own))
    found = _explore(checkpoint(own.join(lists, "node")), heads, threshold, beam)
    recall = audit(heads, found.where(F.col("kind") == AUDITED).select("a", "n"), threshold)
    low = recall.where(F.col("recall") < LEAST_RECALL)
    if last and not low.isEmpty():
        grp = heads.select(F.col("node").alias("a"), "grp")
        found = found.join(grp, "a").join(low, "grp", "left_anti").drop("grp").unionByName(_compare_all(heads.join(low, "grp", "left_semi"), threshold))
        recall = recall.withColumn("recall", F.when(F.col("recall") < LEAST_RECALL, 1.0).otherwise(F.col("recall")))
    return found, members, recall


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, shard: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall), one row for each row of ``table``.

    Vectors are linked if their labels are equal and not null and their cosine, in double precision, is ``threshold`` or
    more. Null vectors, zero ones, those with null or non-finite components, and rows without an id or a label link with
    nothing, nor do vectors of different lengths. Exact copies are one node that counts for each. Nodes so close to a
    leader that any two around it are linked form a ball, whose links follow from its size. Leaders are put into
    overlapping cluster shards; a pruned graph is built in each, the lists of all are united, and searches by range over
    them go from the shards' medoids through every shard that partners lead to. What is near the threshold, and all
    members of larger balls, are compared in double precision, so no link below it comes out. Pairs are counted where
    they are found; what leaves a task are counts and stars that connect the same vectors, not pairs.

    Some vectors of each label are audited against all its leaders after every build (``recall``, null where they have
    no partners). Labels with a recall below LEAST_RECALL are built anew with twice the overlap and searched
    twice as widely, and those that still miss links are compared in full.

    A repeated id is a vector of its own with that id. An empty table gives no rows. The tables of all steps but the last are
    deleted.
    """
    with steps(table.sparkSession):
        rows, counted = _counted(table, id_col, vector_col, label_col, threshold, shard, overlap)
    linked = rows.where("ok").join(counted, ["grp", "h", "vec"]).select("vec_id", "n_links", "component_id", "recall")
    none = F.lit(None).cast("double")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), none.alias("recall"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "recall")


def _counted(table: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, shard: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table``, and their distinct vectors with links, component and recall, the only step that stays."""
    vector = named(table, vector_col)
    if dict(table.dtypes)[vector_col] != "array<float>":
        vector = vector.cast("array<double>")
    rows = table.select(named(table, id_col).cast("long").alias("vec_id"), vector.alias("vec"), named(table, label_col).cast("string").alias("label"))
    rows = rows.withColumn("ok", _usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("grp", F.when(F.col("ok"), F.concat_ws(":", F.size("vec").cast("string"), "label"))).withColumn("h", F.xxhash64("vec"))
    nodes = checkpoint(rows.where("ok").groupBy("grp", "h", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult")))
    # vectors that share their smallest id would be one node: then nodes are told apart by a number of their own
    unique = nodes.groupBy("least").count().where("count > 1").isEmpty()
    nodes = checkpoint(nodes.withColumn("node", F.col("least") if unique else F.monotonically_increasing_id()))
    left, attempts = nodes, []
    for attempt in range(ATTEMPTS):
        found, members, recall = _tried(left, threshold, shard, overlap << attempt, graph.BEAM << attempt, attempt == ATTEMPTS - 1)
        low = checkpoint(recall.where(F.col("recall") < LEAST_RECALL).select("grp"))
        attempts.append((found, members, recall, low))
        if low.isEmpty():
            break
        left = left.join(low, "grp", "left_semi")
    good = lambda frame, k: frame if k == len(attempts) - 1 else frame.join(attempts[k][3], "grp", "left_anti")
    members = reduce(DataFrame.unionByName, [good(m, k) for k, (_, m, _, _) in enumerate(attempts)])
    recall = reduce(DataFrame.unionByName, [good(r, k) for k, (_, _, r, _) in enumerate(attempts)])
    found = reduce(DataFrame.unionByName, [f if k == len(attempts) - 1 else good(f.join(m.select(F.col("node").alias("a"), "grp"), "a"), k).drop("grp") for k, (f, m, _, _) in enumerate(attempts)])
    links = _verified(checkpoint(found.where(F.col("kind") == BALLS).select("a", "b").distinct()), members, threshold)
    edges = found.where(F.col("kind") == STAR).select("a", "b").unionByName(links.where("a < b").select("a", "b")).distinct()
    joined = connected_components(edges)
    outside = links.groupBy("node").agg(F.sum("links").alias("outside"))
    whole = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("leader")).agg(F.sum("n").alias("whole"))
    counted = members.select("node", "leader", "grp", "ball").join(whole, "leader", "left").join(outside, "node", "left").join(joined.withColumnRenamed("node", "leader"), "leader", "left").join(recall, "grp", "left")
    others = F.col("ball") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("outside", F.lit(0))
    counted = counted.select("node", others.alias("n_links"), F.coalesce("component", "leader").alias("component"), "recall")
    counted = checkpoint(counted.join(nodes.select("node", "grp", "h", "vec", "least"), "node"))
    smallest = counted.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, checkpoint(counted.join(smallest, "component").select("grp", "h", "vec", "n_links", "component_id", "recall"), stays=True)
