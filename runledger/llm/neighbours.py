"""Nearest neighbours by cosine: NN-descent builds a neighbour graph in iterative joins, queries walk it greedily."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import mix, staged
from runledger.llm.vectors import lists, matrix, usable

#: Neighbours in the list of a node.
DEGREE = 32
#: Of its new, and of its old, neighbours a node and each node that lists it bring so many into a round of the descent.
BROUGHT = 18
#: Candidates that a member gets from each node where it meets others.
TOLD = 4
#: The descent ends when a round changes less than this share of all list entries, or after ROUNDS.
SETTLED, ROUNDS = 0.05, 6
#: The first lists: nearest of those in the same cell of TABLES random cuts into cells of about CELL nodes.
TABLES, CELL = 4, 1_024
#: Nodes whose lists are worked on in one group.
BLOCK = 512
#: Nodes that a query keeps on its walk; it ends when all of them have been visited.
BEAM = 160
#: Vectors on which the cuts of the first lists are fitted.
SAMPLE = 10_000
SEED = 11

I64, F32, I8 = pa.int64(), pa.float32(), pa.int8()


def unit_codes(v: np.ndarray) -> np.ndarray:
    """Directions as signed bytes; what is searched with, while scores are those of the vectors."""
    return np.rint(v / np.abs(v).max(1, keepdims=True) * 127).astype(np.int8)


def directions(codes: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision; scaled first, so that no square overflows or vanishes."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, vector, code): equal vectors are one node, under their smallest id; vectors of zeros are none."""
    apart = rows.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda v: v != 0)).select("vector").distinct()
    schema = T.StructType([T.StructField("node", T.LongType()), *rows.select("vector").schema.fields, T.StructField("code", T.BinaryType())])
    # different vectors may share an id, so nodes are numbered; the numbers are only names
    numbered = apart.select(F.monotonically_increasing_id().alias("node"), "vector")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = unit_codes(matrix(batch.column(1), len(batch.column(1)[0])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], schema.names)

    return numbered.mapInArrow(run, schema)


def _block(node: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


def _chosen(node: np.ndarray, near: np.ndarray, state: np.ndarray, turn: int) -> np.ndarray:
    """States of the list entries, by seeded draws: 2 new and brought, 1 new, 3 old and brought, 0 old; -1 no entry."""
    draw = mix(mix(node.astype(np.uint64)[:, None] + np.uint64(turn << 40)) ^ near.astype(np.uint64))
    out = state.copy()
    for mark, to in ((1, 2), (0, 3)):
        own = np.where(state == mark, draw, np.uint64(2 ** 64 - 1))
        place = own.argsort(1).argsort(1)
        out[(state == mark) & (place < BROUGHT)] = to
    return out


def _best(owner: np.ndarray, near: np.ndarray, sim: np.ndarray, state: np.ndarray, owners: np.ndarray, keep: int):
    """The `keep` most similar entries of each owner as matrices, without repeats; of repeats the lower state stays."""
    order = np.lexsort((state, near, owner))
    owner, near, sim, state = owner[order], near[order], sim[order], state[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, sim, state = owner[first], near[first], sim[first], state[first]
    order = np.lexsort((near, -sim, owner))
    owner, near, sim, state = owner[order], near[order], sim[order], state[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    row = np.searchsorted(owners, owner)
    kept = place < keep
    out = (np.full((len(owners), keep), -1, np.int64), np.full((len(owners), keep), -2, np.float32), np.full((len(owners), keep), -1, np.int8))
    for matrix_, values in zip(out, (near, sim, state), strict=True):
        matrix_[row[kept], place[kept]] = values[kept]
    return out


GRAPH = "node long, near array<long>, sim array<float>, state array<byte>, changed int"


def _graph_table(node: np.ndarray, near: np.ndarray, sim: np.ndarray, state: np.ndarray, turn: int) -> pa.Table:
    changed = (state == 1).sum(1).astype(np.int32)
    state = _chosen(node, near, state, turn)
    return pa.table({"node": pa.array(node, I64), "near": lists(near, I64), "sim": lists(sim, F32), "state": lists(state, I8), "changed": pa.array(changed)})


def _merged(graph: DataFrame | None, told: DataFrame, blocks: int, degree: int, turn: int) -> DataFrame:
    """New lists from the old ones and the candidates (node, near, sim); a block of nodes is a group."""
    told = told.withColumn("block", _block("node", blocks))

    def run(old: pa.Table | None, new: pa.Table) -> pa.Table:
        owner, near, sim = (new[c].to_numpy() for c in ("node", "near", "sim"))
        state = np.ones(len(owner), np.int8)
        owners = owner
        if old is not None and old.num_rows:
            own = old["node"].to_numpy()
            k = len(old["near"][0])
            before = [old[c].combine_chunks().flatten().to_numpy() for c in ("near", "sim", "state")]
            real = before[0] >= 0
            marks = np.where(before[2] == 1, 1, 0).astype(np.int8)
            owner = np.concatenate([np.repeat(own, k)[real], owner])
            near, sim, state = (np.concatenate([a[real], b]) for a, b in zip((before[0], before[1], marks), (near, sim, state), strict=True))
            owners = np.concatenate([own, owners])
        owners = np.unique(owners)
        return _graph_table(owners, *_best(owner, near, sim, state, owners, degree), turn)

    if graph is None:
        return told.groupBy("block").applyInArrow(lambda new: run(None, new), GRAPH)
    return graph.withColumn("block", _block("node", blocks)).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, GRAPH)


def _first_lists(nodes: DataFrame, n: int, d: int, blocks: int, degree: int) -> DataFrame:
    """Lists among the nodes that share a cell of random cuts, or of one table dealt at random, so that every node has a list.

    Cuts go through the medians of a bounded sample (SAMPLE vectors of lowest hash); a cell of more than twice CELL nodes is
    dealt into parts at random.
    """
    sample = nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(SAMPLE).select("code").collect()
    known = directions([r.code for r in sample])
    bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    rnd = np.random.default_rng(SEED)
    axes = [rnd.standard_normal((d, bits)).astype(np.float32) for _ in range(TABLES)]
    medians = [np.median(known @ a, axis=0) for a in axes]

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                v = directions(part.column(1).to_pylist())
                cells = [((v @ a > m) @ (1 << np.arange(bits, dtype=np.int64))) * TABLES + t for t, (a, m) in enumerate(zip(axes, medians, strict=True))]
                repeat = pa.array(np.tile(np.arange(len(v)), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int64)), part.column(0).take(repeat), part.column(1).take(repeat)], ["cell", "node", "code"])

    dealt = nodes.select("node", "code").mapInArrow(cut, "cell long, node long, code binary")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / (2 * CELL)).cast("long")
    dealt = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), parts)).drop("n")
    random = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(max(1, n // CELL)).cast("long"))
    dealt = dealt.unionByName(nodes.select(F.lit(-1).cast("long").alias("cell"), "node", "code", random.alias("part")))

    def nearest(table: pa.Table) -> pa.Table:
        node, v = table["node"].to_numpy(), directions(table["code"].to_pylist())
        k = min(degree, len(node) - 1)
        if k < 1:
            return pa.table({"node": pa.array([], I64), "near": pa.array([], I64), "sim": pa.array([], F32)})
        found, sims = [], []
        for at in range(0, len(v), 512):
            s = v[at:at + 512] @ v.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.append(node[best])
            sims.append(np.take_along_axis(s, best, 1))
        return pa.table({"node": pa.array(np.repeat(node, k), I64), "near": pa.array(np.concatenate(found).ravel(), I64), "sim": pa.array(np.concatenate(sims).ravel(), F32)})

    told = dealt.groupBy("cell", "part").applyInArrow(nearest, "node long, near long, sim float")
    return _merged(None, told, blocks, degree, 0)


def _meetings(graph: DataFrame) -> DataFrame:
    """(owner, member, fresh): whom each node brings together: neighbours that it lists, and nodes that list it.

    Of the nodes that list one node, a hash draws at most BROUGHT new and BROUGHT old ones, so that a node which very many
    list brings no more together than another.
    """
    brought = graph.select("node", F.explode(F.arrays_zip("near", "state")).alias("e")).where("e.state > 1")
    listed = brought.select("node", F.col("e.near").alias("near"), (F.col("e.state") == 2).alias("fresh"))
    order = Window.partitionBy("near", "fresh").orderBy(F.xxhash64("near", "node"), "node")
    back = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BROUGHT)
    both = listed.select(F.col("node").alias("owner"), F.col("near").alias("member"), "fresh").union(back.select("near", "node", "fresh"))
    return both.groupBy("owner", "member").agg(F.max("fresh").alias("fresh"))


def _told(graph: DataFrame, codes: DataFrame, blocks: int) -> DataFrame:
    """Candidates (node, near, sim) from neighbours of neighbours: members that meet at an owner are compared if one is new."""
    worst = graph.select(F.col("node").alias("member"), F.element_at("sim", -1).alias("worst"))
    known = codes.select(F.col("node").alias("member"), "code").join(worst, "member")
    met = _meetings(graph).join(known, "member").withColumn("block", _block("owner", blocks))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        owner, member, fresh = (table[c].to_numpy() for c in ("owner", "member", "fresh"))
        order = np.argsort(owner, kind="stable")
        codes = table["code"].to_pylist()
        v, worst = directions(codes), table["worst"].to_numpy()
        edges = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            if len(rows) < 2 or not fresh[rows].any():
                continue
            s = v[rows] @ v[rows].T
            old = ~fresh[rows]
            s[np.ix_(old, old)] = -2
            np.fill_diagonal(s, -2)
            k = min(TOLD, len(rows) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(sim > worst[rows][:, None])
            out.append((member[rows[i]], member[rows[best[i, j]]], sim[i, j]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        # a pair that met at several owners of the block is told once
        pair = np.lexsort(parts[1::-1])
        pair = pair[np.r_[True, np.any([np.diff(p[pair]) != 0 for p in parts[:2]], axis=0)]] if len(pair) else pair
        return pa.table({"node": pa.array(parts[0][pair], I64), "near": pa.array(parts[1][pair], I64), "sim": pa.array(parts[2][pair], F32)})

    return met.groupBy("block").applyInArrow(run, "node long, near long, sim float")


def neighbour_graph(nodes: DataFrame, n: int, d: int, degree: int = DEGREE) -> DataFrame:
    """(node, near): for each node its nearest others as found by NN-descent, most similar first; -1 fills short lists.

    In each round every node compares the new members of its neighbourhood with each other and with the old ones, and tells each
    of them the best it did not know. A round is written to the shared folder, so that lost executors repeat one round at most.
    """
    blocks = max(1, math.ceil(n / BLOCK))
    codes = nodes.select("node", "code")
    graph = staged(_first_lists(nodes, n, d, blocks, degree), "neighbours")
    for turn in range(1, ROUNDS + 1):
        graph = staged(_merged(graph, _told(graph, codes, blocks), blocks, degree, turn), "neighbours")
        # entries that entered and were not yet brought anywhere
        if graph.agg(F.sum("changed")).first()[0] <= SETTLED * n * degree:
            break
    return graph.select("node", "near")


STATE = "node long, code binary, near array<long>, sim array<float>, state array<byte>"


def _walk(starts: DataFrame, codes: DataFrame, graph: DataFrame, blocks: int) -> DataFrame:
    """(node, near): for the nodes of `starts` the BEAM best nodes that a greedy walk over the graph meets, best first.

    Every round visits all nodes of a query's beam that it hasn't visited, and merges their lists into the beam.
    """

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        node = old["node"].to_numpy()
        owners = np.sort(node)
        codes_ = [old["code"][int(i)].as_py() for i in np.argsort(node)]
        k = len(old["near"][0])
        before = [old[c].combine_chunks().flatten().to_numpy() for c in ("near", "sim", "state")]
        real = before[0] >= 0
        owner, near = new["query"].to_numpy(), new["near"].to_numpy()
        sim = np.zeros(0, np.float32)
        if len(owner):
            at = np.searchsorted(owners, owner)
            sim = np.einsum("ij,ij->i", directions(codes_)[at], directions(new["code"].to_pylist()))
        # 0: visited, 1: not
        merged = _best(np.concatenate([np.repeat(node, k)[real], owner]), np.concatenate([before[0][real], near]),
                       np.concatenate([before[1][real], sim]), np.concatenate([np.zeros(real.sum(), np.int8), np.ones(len(owner), np.int8)]), owners, BEAM)
        return pa.table({"node": pa.array(owners, I64), "code": pa.array(codes_, pa.binary()), "near": lists(merged[0], I64),
                         "sim": lists(merged[1], F32), "state": lists(merged[2], I8)})

    none = F.array().cast("array<long>")
    beam = starts.join(codes, "node").select(
        "node", "code", F.array(F.lit(-1).cast("long")).alias("near"), F.array(F.lit(-2).cast("float")).alias("sim"), F.array(F.lit(-1).cast("byte")).alias("state"))
    beam = staged(beam, "beams")
    todo = starts.select("node", F.col("node").alias("at"))
    while True:
        lists_ = todo.join(graph.select(F.col("node").alias("at"), F.coalesce("near", none).alias("found")), "at")
        seen = lists_.select(F.col("node").alias("query"), F.explode("found").alias("near")).where("near >= 0 and near != query").distinct()
        scored = seen.join(codes.select(F.col("node").alias("near"), "code"), "near")
        grouped = beam.withColumn("block", _block("node", blocks)).groupBy("block").cogroup(scored.withColumn("block", _block("query", blocks)).groupBy("block"))
        beam = staged(grouped.applyInArrow(run, STATE), "beams")
        todo = beam.select("node", F.explode(F.arrays_zip("near", "state")).alias("e")).where("e.state = 1").select("node", F.col("e.near").alias("at"))
        if todo.isEmpty():
            return beam.select("node", "near")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of largest cosine that were found.

    All rows are indexed and all are candidates but those with the query's own id; ties go to the smaller id. Equal vectors are one
    node of the graph, so a group of copies is searched once, and gives the k + 1 smallest of its ids. What the walk finds is
    scored with the vectors themselves in double precision.

    Rows without an id, vectors that are null, empty, zero or hold null or non-finite entries, and vectors of another length than
    the commonest take no part. A row that repeats id and vector counts once; different vectors under one id are candidates and
    queries each, and an id is given once for a query, with its best score. An empty table gives no rows, a query without
    candidates none. Other columns are not read.
    """
    rows, d = usable(vectors, id, vector)
    rows = rows.where(F.col("vec_id").isNotNull()).withColumn("vec_id", F.col("vec_id").cast("long"))
    nodes = staged(_nodes(rows), "nodes")
    n = nodes.count()
    members = staged(rows.join(nodes.select("node", "vector"), "vector").select("node", "vec_id").distinct(), "members")
    queries = members.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    starts = staged(queries.select("node").distinct(), "starts")
    codes = nodes.select("node", "code")
    blocks = max(1, math.ceil(n / BLOCK))
    own = starts.select("node", F.col("node").alias("near"))
    found = own
    if n > 1 and d:
        walked = _walk(starts, codes, neighbour_graph(nodes, n, d), blocks)
        found = own.union(walked.select("node", F.explode("near").alias("near")).where("near >= 0"))

    place = Window.partitionBy("node").orderBy("vec_id")
    few = staged(members.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place"), "few-members")
    scored = _scored(found, nodes, d)
    ids = scored.join(few.withColumnRenamed("node", "near"), "near")
    # the k + 1 best ids of a node serve all its queries, each of which leaves out its own
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    once = ids.groupBy("node", "vec_id").agg(F.max("score").alias("score"))
    shared = once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    rank = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
    ranked = queries.join(shared, "node").where("query_id != vec_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scored(pairs: DataFrame, nodes: DataFrame, d: int) -> DataFrame:
    """(node, near, score): exact cosines of the vectors of the pairs."""
    one = nodes.select("node", F.col("vector").alias("a"))
    other = nodes.select(F.col("node").alias("near"), F.col("vector").alias("b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = cosine(matrix(batch.column(2), d), matrix(batch.column(3), d))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["node", "near", "score"])

    return pairs.join(one, "node").join(other, "near").select("node", "near", "a", "b").mapInArrow(run, "node long, near long, score double")
