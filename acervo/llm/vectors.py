"""Near-duplicate vectors: small-world graphs per shard, every shard searched, exact cosines, components.

Vectors are dealt into shards by a hash, and each shard builds a hierarchical navigable
small-world graph.  A vector within half the threshold's angle of a node joins that node's
ball instead of becoming a node: any two members of a ball are at most the threshold apart,
so a group of any number of near copies costs a shard one node and all links inside it are
known without listing them.  Every node then searches the graph of every shard for all
nodes whose balls may reach it.  In each task the beam is doubled until an audit passes:
queries of the task and probes set at the search angle from known nodes are compared with
brute force.  A query whose beam is full of hits is searched again with a wider one.  A walk
costs its beam times what some ``WALK`` nodes cost by matrix products, so where a shard has
fewer nodes than that, the beam is the whole shard.

What is found is decided by exact angles in double precision: two balls so near that all
their members are linked count whole, and where some pairs may fail the threshold, the
members are compared in blocks.  Links are counted, components united; pairs of members are
never listed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.hnsw import BATCH, Graph, angles
from acervo.llm.neardup import components
from acervo.operators.vector import _within
from acervo.session import written

COSINE = 0.95
#: Vectors of a shard at most, and shards at least (for enough tasks on small inputs).
SHARD, SHARDS = 200_000, 8
#: Nodes that search together; blocks of them that share one copy of a shard's graph, at most and for enough tasks.
QUERIES, SLICE, SLICES = 1024, 256, 3
#: First width of a beam; queries and probes of an audit; the part of the nodes in reach it must find.
BEAM, AUDIT, RECALL = 16, 32, 0.995
#: Nodes of 64 components compared by matrix products in the time that a walk takes for one place of its beam (measured: 5000).
WALK = 4000
#: Members of two balls that are compared in one block; pairs of balls that share one copy of a block.
MEMBERS, PAIRS = 64, 512
#: Bytes of a graph in one row.
PIECE = 16_000_000
#: Slack of angles against rounding; what lies within it is compared by cosine.
SLACK = 1e-6


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec) per row: the unit vector as packed doubles and its 128-bit hash, null where it has no direction."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            packed: list[bytes | None] = [None] * len(lists)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            values = lists.flatten()
            flat = np.asarray(values.fill_null(float("nan")) if values.null_count else values)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                own = flat[(ends[at] - size)[:, None] + np.arange(size)]
                most = np.abs(own).max(axis=1)
                fine = np.isfinite(own).all(axis=1) & (most > 0)
                own = own[fine] / most[fine][:, None]
                own = own / np.linalg.norm(own, axis=1)[:, None] + 0.0  # no negative zeros
                for i, vec in zip(at[fine], own):
                    packed[i] = vec.tobytes()
            keys = [None if p is None else xxhash.xxh3_128_digest(p) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "key", "vec"])

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(pack, "vec_id long, key binary, vec binary")


def table_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def dealt_to_balls(graph: Graph, vectors: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add ``vectors`` to an empty graph: (ball of each, its angle to the ball's node, node vectors)."""
    ball, angle = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    nodes = np.zeros((0, vectors.shape[1]))
    at = 0
    while at < len(vectors):
        batch = vectors[at:at + min(BATCH, max(16, graph.count))]
        own = np.full(len(batch), -1)
        if graph.count:
            found, _ = graph.search(batch.astype(np.float32), BEAM)
            off = angles(batch, nodes[found[:, 0]])
            inside = off <= radius
            own[inside], angle[at:at + len(batch)][inside] = found[inside, 0], off[inside]
        left = np.flatnonzero(own < 0)
        fresh: list[int] = []
        mutual = batch[left] @ batch[left].T
        for i in range(len(left)):
            if fresh:
                best = fresh[int(mutual[i, fresh].argmax())]
                off = float(angles(batch[left[i]], batch[left[best]]))
                if off <= radius:
                    own[left[i]], angle[at + left[i]] = own[left[best]], off
                    continue
            own[left[i]] = graph.count + len(fresh)
            fresh.append(i)
        ball[at:at + len(batch)] = own
        if fresh:
            nodes = np.concatenate([nodes, batch[left[fresh]]])
            graph.add(batch[left[fresh]])
        at += len(batch)
    return ball, angle, nodes


def shard_graphs(classes: DataFrame, shards: int, reach: float) -> DataFrame:
    """The graphs of all shards and their balls, as rows of three kinds.

    ``classes``: cid, n, vec, length, distinct vectors.  Kind ``graph``: pieces of a shard's
    graph; ``block``: nodes that will search; ``member``: a class with its ball and angle.
    """
    radius = max(0.0, reach / 2 - SLACK)
    columns = ["kind", "length", "shard", "part", "ball", "cid", "n", "angle", "vec"]

    def shard_rows(length: int, shard: int, cid: np.ndarray, n: np.ndarray, packed: list[bytes]) -> Iterator[pd.DataFrame]:
        order = np.argsort(cid)
        cid, n, packed = cid[order], n[order], [packed[i] for i in order]
        vectors = matrix(packed)
        graph = Graph(length, seed=shard)
        ball, angle, nodes = dealt_to_balls(graph, vectors, radius)
        first = np.full(graph.count, -1)
        first[ball[::-1]] = np.arange(len(ball))[::-1]  # a ball's first member is its node
        names = cid[first]
        wide = np.zeros(graph.count)
        np.maximum.at(wide, ball, angle)
        weight, rows = np.zeros(graph.count, np.int64), np.bincount(ball, minlength=graph.count)
        np.add.at(weight, ball, n)
        balls = dict(names=names, nodes=nodes, wide=wide, weight=weight, rows=rows)
        data = graph.to_bytes(**balls)
        out = [("graph", length, shard, part, None, None, None, None, data[at:at + PIECE]) for part, at in enumerate(range(0, len(data), PIECE))]
        for part, at in enumerate(range(0, graph.count, QUERIES)):
            out.append(("block", length, shard, part, None, None, None, None, table_bytes(**{k: v[at:at + QUERIES] for k, v in balls.items()})))
        yield pd.DataFrame(out, columns=columns)
        for at in range(0, len(cid), 4096):
            cut = slice(at, at + 4096)
            yield pd.DataFrame({"kind": "member", "length": length, "shard": shard, "part": 0, "ball": names[ball[cut]], "cid": cid[cut], "n": n[cut], "angle": angle[cut], "vec": packed[cut]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for key, group in batch.groupby(["length", "shard"], sort=False):
                if held and key != (held[-1]["length"].iat[0], held[-1]["shard"].iat[0]):
                    yield from whole(held)
                    held = []
                held.append(group)
        if held:
            yield from whole(held)

    def whole(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(held)
        return shard_rows(int(group["length"].iat[0]), int(group["shard"].iat[0]), group["cid"].to_numpy(), group["n"].to_numpy(), group["vec"].tolist())

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    placed = dealt.repartition(4 * shards, "length", "shard").sortWithinPartitions("length", "shard")
    return placed.mapInPandas(run, "kind string, length int, shard int, part int, ball long, cid long, n long, angle double, vec binary")


class Reach:
    """All nodes of a graph within an angle of a query, by beams that grow until an audit passes."""

    def __init__(self, graph: Graph, wide: float, recall: float = RECALL):
        self.graph, self.wide, self.recall, self.beam = graph, wide, recall, min(BEAM, graph.count)

    def search(self, queries: np.ndarray, least: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes found with a cosine of at least ``least``; full beams are widened."""
        if beam * WALK * 64 >= self.graph.count * max(64, queries.shape[1]) or beam >= self.graph.count:
            return _within(-queries, self.graph.vectors, -least)
        nodes, cosines = self.graph.search(queries, beam)
        full = (nodes[:, -1] >= 0) & (cosines[:, -1] >= least)
        q, k = np.nonzero((cosines >= least[:, None]) & (nodes >= 0) & ~full[:, None])
        found = q, nodes[q, k]
        if not full.any():
            return found
        at = np.flatnonzero(full)
        wider = self.search(queries[at], least[at], 2 * beam)
        return np.concatenate([found[0], at[wider[0]]]), np.concatenate([found[1], wider[1]])

    def audit(self, queries: np.ndarray, least: np.ndarray, angle: float) -> None:
        """Double the beam until a sample of the queries, and probes at ``angle`` from nodes, reach what brute force finds."""
        pick = np.unique(np.linspace(0, len(queries) - 1, AUDIT).astype(int))
        known = self.graph.vectors[np.unique(np.linspace(0, self.graph.count - 1, AUDIT).astype(int))].astype(np.float64)
        turn = np.random.default_rng(len(known)).standard_normal(known.shape)
        turn -= np.einsum("ij,ij->i", turn, known)[:, None] * known
        turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-300)[:, None]  # in one dimension a probe is the node itself
        probes = (np.cos(angle) * known + np.sin(angle) * turn).astype(np.float32)
        asked = np.concatenate([queries[pick], probes])
        bound = np.concatenate([least[pick], np.full(len(probes), np.float32(np.cos(angle) - SLACK))])
        there = int((asked @ self.graph.vectors.T >= bound[:, None]).sum())
        while self.beam < self.graph.count and len(self.search(asked, bound, self.beam)[0]) < self.recall * there:
            self.beam = min(2 * self.beam, self.graph.count)


def ball_pairs(graphs: DataFrame, shards: int, cosine: float) -> DataFrame:
    """Pairs of balls (a, b) that may hold linked members, from searching every shard with every node."""
    reach = float(np.arccos(cosine))
    blocks = graphs.where("kind = 'block'").select("length", F.col("shard").alias("origin"), "part", "vec")
    pieces = graphs.where("kind = 'graph'").select("length", "shard", "part", "vec")
    counts = blocks.groupBy("length").agg(F.count(F.lit(1)).alias("blocks")).select(
        "length", F.greatest(F.ceil(F.col("blocks") / SLICE), F.least("blocks", F.lit(SLICES))).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("origin", "part"), F.col("slices")).cast("int")
    # one row per block and shard: every node searches every shard
    asked = blocks.join(counts, "length").select("length", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), own.alias("slice"), F.lit(1).alias("role"), (F.col("origin") * 1_000_000 + F.col("part")).cast("long").alias("part"), "vec")
    held = pieces.join(counts, "length").select("length", "shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), F.col("part").cast("long").alias("part"), "vec")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, data, target = None, [], None
        for batch in batches:
            for length, shard, slice_, role, vec in zip(batch["length"], batch["shard"], batch["slice"], batch["role"], batch["vec"], strict=True):
                if group != (length, shard, slice_):
                    group, data, target = (length, shard, slice_), [], None
                if role == 0:
                    data.append(vec)
                    continue
                if not data:  # a shard without vectors
                    continue
                if target is None:
                    graph, balls = Graph.from_bytes(b"".join(data))
                    target = Reach(graph, float(balls["wide"].max()))
                yield from found(target, balls, dict(np.load(io.BytesIO(vec))))

    def found(target: Reach, balls: dict, block: dict) -> Iterator[pd.DataFrame]:
        queries = block["nodes"].astype(np.float32)
        least = np.cos(np.minimum(reach + block["wide"] + target.wide + SLACK, np.pi)).astype(np.float32) - np.float32(SLACK)
        target.audit(queries, least, reach + target.wide)
        q, node = target.search(queries, least, target.beam)
        u, v = block["nodes"][q], balls["nodes"][node]
        off = angles(u, v)
        near = (off <= reach + block["wide"][q] + balls["wide"][node] + SLACK) & (block["names"][q] != balls["names"][node])
        q, node, off = q[near], node[near], off[near]
        exact = np.einsum("ij,ij->i", u[near], v[near])
        side = lambda of, at, c: {f"{k}_{c}": of[k][at] for k in ("names", "wide", "weight", "rows")}
        out = pd.DataFrame({**side(block, q, "a"), **side(balls, node, "b"), "angle": off, "cosine": exact})
        turned = out["names_a"] > out["names_b"]
        swap = {f"{k}_{c}": f"{k}_{'b' if c == 'a' else 'a'}" for k in ("names", "wide", "weight", "rows") for c in "ab"}
        yield pd.concat([out[~turned], out[turned].rename(columns=swap)])[list(out.columns)]

    tasks = 4 * shards * SLICES
    rows = held.unionByName(asked).repartition(tasks, "length", "shard", "slice").sortWithinPartitions("length", "shard", "slice", "role", "part")
    schema = ", ".join(f"names_{c} long, wide_{c} double, weight_{c} long, rows_{c} long" for c in "ab") + ", angle double, cosine double"
    return rows.mapInPandas(run, schema).dropDuplicates(["names_a", "names_b"])


def compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(cid, links, a, b) for members of pairs of balls that are linked across, compared block by block.

    ``pairs``: names_a, rows_a, names_b, rows_b.  The blocks of the larger ball stay; those
    of the smaller are sent to each of them.
    """
    larger = F.col("rows_a") >= F.col("rows_b")
    sized = pairs.select(*[F.when(larger, F.col(f"{k}_{x}")).otherwise(F.col(f"{k}_{y}")).alias(f"{k}_{side}") for k in ("names", "rows") for side, x, y in (("big", "a", "b"), ("small", "b", "a"))])
    wanted = sized.select(F.col("names_big").alias("ball"), F.col("rows_big").alias("rows")).union(sized.select("names_small", "rows_small")).distinct()
    cut = members.join(wanted, "ball").withColumn("block", F.pmod(F.xxhash64("vec"), F.ceil(F.col("rows") / MEMBERS)).cast("int"))
    blocks = written(cut.groupBy("ball", "block").agg(F.collect_list(F.struct("cid", "n", "vec")).alias("held")), "vector-blocks")
    parts = sized.groupBy("names_big").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    dealt = sized.join(parts, "names_big").withColumn("part", F.pmod(F.xxhash64("names_small"), F.col("parts")).cast("int"))
    every = lambda rows: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(rows) / MEMBERS) - 1).cast("int")))
    stays = dealt.select("names_big", "rows_big", "part").distinct().select("names_big", "part", every("rows_big").alias("block"))
    stays = stays.join(blocks, (F.col("names_big") == F.col("ball")) & (stays["block"] == blocks["block"])).select("names_big", "part", stays["block"].alias("at"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("other"), "held")
    sent = dealt.select("names_big", "rows_big", "names_small", "part", every("rows_small").alias("block"))
    sent = sent.join(blocks, (F.col("names_small") == F.col("ball")) & (sent["block"] == blocks["block"])).select("names_big", "rows_big", "part", "names_small", "held")
    sent = sent.select("names_big", "part", every("rows_big").alias("at"), F.lit(1).alias("role"), F.col("names_small").alias("other"), "held")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own = None, None
        for batch in batches:
            out: list[tuple] = []
            for big, part, at, role, other, held in zip(batch["names_big"], batch["part"], batch["at"], batch["role"], batch["other"], batch["held"], strict=True):
                if group != (big, part, at):
                    group, own = (big, part, at), None
                packed = [h["vec"] for h in held]
                side = [h["cid"] for h in held], matrix(packed), np.array([h["n"] for h in held])
                if role == 0:
                    own = side
                    continue
                if own is None:
                    continue
                like = own[1] @ side[1].T >= cosine
                for mine, links in ((own, like @ side[2]), (side, own[2] @ like)):
                    for i in np.flatnonzero(links):
                        out.append((mine[0][i], int(links[i]), int(min(big, other)), int(max(big, other))))
            yield pd.DataFrame(out, columns=["cid", "links", "a", "b"])

    rows = stays.unionByName(sent).repartition("names_big", "part", "at").sortWithinPartitions("names_big", "part", "at", "role")
    return rows.mapInPandas(run, "cid long, links long, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, shards: int = SHARDS) -> DataFrame:
    """The links and the component of every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Two vectors are linked when their cosine, in double precision, is at least ``cosine``
    (above 0, at most 1).  Returns (vec_id, n_links, component_id, kept), one row per input
    row: the number of other rows linked directly and the smallest vec_id reachable.  A
    shard holds ``shard`` vectors at most; there are ``shards`` of them at least.

    Null, empty and zero vectors, and those with a null or non-finite component, are linked
    with nothing, as are vectors of different lengths; rows that share a vec_id are vectors
    of their own whose links all lead on; a row without vec_id is compared with nothing
    (component_id null, kept); an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    reach = float(np.arccos(cosine))
    rows = written(unit_vectors(vectors), "vector-rows")
    known = rows.where("key is not null and vec_id is not null")
    grouped = known.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = written(grouped.select("key", "rep", "n", "vec", (F.length("vec") / 8).cast("int").alias("length"), F.monotonically_increasing_id().alias("cid")), "vector-classes")
    count = classes.count()
    dealt = max(shards, -(-count // shard))
    graphs = written(shard_graphs(classes.select("cid", "n", "vec", "length"), dealt, reach), "vector-graphs")
    pairs = written(ball_pairs(graphs, dealt, cosine), "vector-pairs")
    members = graphs.where("kind = 'member'").select("ball", "cid", "n", "vec")
    single = (F.col("rows_a") == 1) & (F.col("rows_b") == 1)
    all_linked = F.when(single, F.col("cosine") >= cosine).otherwise(F.col("angle") + F.col("wide_a") + F.col("wide_b") <= reach - SLACK)
    linked, open_ = pairs.where(all_linked), pairs.where(~all_linked & ~single)
    across = written(compared(open_.select("names_a", "rows_a", "names_b", "rows_b"), members, cosine), "vector-compared")

    own = members.select("ball", "cid").join(classes.select("cid", "key", "rep", "n"), "cid")
    whole = own.groupBy("ball").agg(F.sum("n").alias("weight"), F.min("rep").alias("least"))
    beside = linked.select(F.col("names_a").alias("ball"), F.col("weight_b").alias("more")).union(linked.select("names_b", "weight_a")).groupBy("ball").agg(F.sum("more").alias("more"))
    edges = linked.select(F.col("names_a").alias("a"), F.col("names_b").alias("b")).union(across.select("a", "b")).distinct()
    # the balls of the vectors of one id are one component
    at = known.select("vec_id", "key").distinct().join(own.select("key", "ball"), "key").select("vec_id", "ball").distinct()
    several = at.groupBy("vec_id").agg(F.min("ball").alias("a"), F.max("ball").alias("last")).where("a <> last").join(at, "vec_id").select("a", F.col("ball").alias("b")).where("a <> b")
    roots = components(edges.union(several))
    placed = whole.join(beside, "ball", "left").join(roots, whole["ball"] == roots["node"], "left").select("ball", (F.col("weight") + F.coalesce("more", F.lit(0)) - 1).alias("near"), F.coalesce("root", "ball").alias("root"), "least")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    more = across.groupBy("cid").agg(F.sum("links").alias("links"))
    result = own.join(placed.join(named, "root"), "ball").join(more, "cid", "left")
    result = written(result.select("key", "n", (F.col("near") + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-result")
    # a vector with a thousandth of all rows is hot; there are at most a thousand, so these are broadcast
    hot = result.where(F.col("n") * 1000 >= rows.count()).drop("n")
    keys = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    found = keys.join(F.broadcast(hot), "key").select("vec_id", "n_links", "component_id")
    rest = keys.join(F.broadcast(hot.select("key")), "key", "left_anti").join(result.drop("n"), "key", "left")
    found = found.unionByName(rest.select("vec_id", "n_links", "component_id"))
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
