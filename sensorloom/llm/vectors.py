"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried, cosines verified."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stored

# Distinct vectors in a shard's graph and in a block of queries, about; a hash deals them.
SHARD, BLOCK = 8192, 1024
# Blocks that meet a shard's graph in one task, at most.
MEETING = 16
# Links of a node on the ground layer, nodes a layer loses going up, and the beam to begin with.
LINKS, SHRINK, BEAM = 24, 16, 48
# Queries of each block that are also answered by brute force.
AUDIT = 64


class Graph:
    """A hierarchical navigable small-world graph over unit vectors. Batches of nodes are put in, batches of queries answered."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers  # layers: neighbours per node, -1 where none; the ground layer first
        self._sources: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def built(cls, vectors: np.ndarray, batch: int = 256) -> "Graph":
        n = len(vectors)
        sizes = [n]
        while sizes[-1] > 4 * SHRINK:
            sizes.append(sizes[-1] // SHRINK)
        # nodes come in a random order, so the first sizes[k] of them are layer k
        graph = cls(vectors, [np.full((size, LINKS), -1, np.int32) for size in sizes])
        for begin in range(0, n, batch):
            graph._insert(begin, min(n, begin + batch))
        return graph

    def _insert(self, begin: int, end: int) -> None:
        new = self.vectors[begin:end]
        entry = self._enter(new, begin)
        within = new @ new.T
        np.fill_diagonal(within, -2)
        for k in reversed(range(len(self.layers))):
            last = min(end, len(self.layers[k]))
            if begin >= last:
                continue
            rows = last - begin
            nearest = np.argsort(-within[:rows, :rows], axis=1)[:, :BEAM]
            found, score = nearest + begin, np.take_along_axis(within[:rows, :rows], nearest, axis=1)
            if begin:
                old, old_score = self._beam(k, new[:rows], entry[:rows], BEAM, begin)
                found, score = np.hstack((old, found)), np.hstack((old_score, score))
            chosen = self._diverse(np.arange(begin, last), found, score)
            self.layers[k][begin:last] = chosen
            self._link_back(k, begin, chosen)

    def _enter(self, queries: np.ndarray, known: int | None = None) -> np.ndarray:
        """A node near each query, by walks with narrow beams down to the layer above the ground."""
        known = len(self.vectors) if known is None else known
        at = np.zeros((len(queries), 1), np.int64)
        for k in reversed(range(1, len(self.layers))):
            if known:
                at = self._beam(k, queries, at, 4, min(known, len(self.layers[k])))[0][:, :1]
        return at

    def _diverse(self, base: np.ndarray, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        """LINKS of the candidates for each node: nearest first, those nearer to a chosen one than to the node only if room is left."""
        order = np.argsort(-score, axis=1, kind="stable")[:, :2 * LINKS]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        real = (score > -2) & (found >= 0)
        held = self.vectors[np.maximum(found, 0)]
        between = np.matmul(held, held.transpose(0, 2, 1))
        chosen = np.zeros(found.shape, bool)
        for c in range(found.shape[1]):
            near = np.where(chosen, between[:, c], -2).max(axis=1)
            chosen[:, c] = real[:, c] & (near < score[:, c]) & (chosen.sum(axis=1) < LINKS // 2)
        rank = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :LINKS]
        out = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(found, rank, 1), -1)
        full = np.full((len(base), LINKS), -1, np.int32)
        full[:, :out.shape[1]] = out
        return full

    def _link_back(self, k: int, begin: int, chosen: np.ndarray) -> None:
        source = np.repeat(np.arange(begin, begin + len(chosen)), LINKS)[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0].astype(np.int64)
        if not len(target):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.vectors[source], self.vectors[target]), target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate((first, [len(target)]))))
        nodes = target[first]
        extra = np.full((len(nodes), LINKS), -1, np.int64)
        fits = place < LINKS
        extra[np.searchsorted(nodes, target[fits]), place[fits]] = source[fits]
        both = np.hstack((self.layers[k][nodes], extra))
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        score = np.einsum("id,icd->ic", self.vectors[nodes], self.vectors[np.maximum(both, 0)])
        self.layers[k][nodes] = self._diverse(nodes, both, np.where(both >= 0, score, -2))

    def _beam(self, k: int, queries: np.ndarray, start: np.ndarray, width: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes of layer k that a beam from `start` meets, by falling cosine; all queries take a step together."""
        b = len(queries)
        row = np.arange(b)[:, None]
        seen = np.zeros((b, known + 1), bool)
        seen[:, known] = True
        found = np.full((b, width), known, np.int64)
        score = np.full((b, width), -2.0)
        done = np.ones((b, width), bool)
        start = np.minimum(start, known - 1)[:, :1]
        found[:, :1], score[:, :1], done[:, :1] = start, np.einsum("id,id->i", queries, self.vectors[start[:, 0]])[:, None], False
        seen[row, start] = True
        live = np.arange(b)
        while len(live):
            open_score = np.where(done[live], -3, score[live])
            best = open_score.argmax(axis=1)
            going = open_score[np.arange(len(live)), best] > -3
            live, best = live[going], best[going]
            if not len(live):
                break
            done[live, best] = True
            near = self.layers[k][found[live, best]].astype(np.int64)
            near = np.where((near < 0) | (near >= known), known, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            held = np.where(fresh, np.einsum("id,icd->ic", queries[live], self.vectors[np.minimum(near, known - 1)]), -2.0)
            all_score = np.hstack((score[live], held))
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :width]
            score[live] = np.take_along_axis(all_score, order, 1)
            found[live] = np.take_along_axis(np.hstack((found[live], near)), order, 1)
            done[live] = np.take_along_axis(np.hstack((done[live], ~fresh)), order, 1)
        found[score <= -2] = -1
        return found, score

    def within(self, queries: np.ndarray, cosine: float, width: int, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Nodes with at least that cosine to each query, as far as a beam of that width and a walk from its hits reach.

        `own` is a query's own node, -1 where it has none; the walk starts from it, too.
        """
        out, own = [], np.full(len(queries), -1) if own is None else own
        for begin in range(0, len(queries), 256):
            part = queries[begin:begin + 256]
            found, score = self._beam(0, part, self._enter(part), width, len(self.vectors))
            for query, nodes, cosines, at in zip(part, found, score, own[begin:begin + 256]):
                hits = nodes[cosines >= cosine]
                if at >= 0 and at not in hits:
                    hits = np.append(hits, at)
                out.append(self._spread(query, hits, cosine) if len(hits) else hits)
        return out

    def _linking(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes whose ground links lead to one of these: no node is cut off because others dropped their links to it."""
        if self._sources is None:
            ground = self.layers[0]
            order = np.argsort(ground, axis=None, kind="stable")
            self._sources = np.searchsorted(ground.ravel()[order], np.arange(len(ground) + 1)), order // LINKS
        bounds, sources = self._sources
        return np.concatenate([sources[bounds[i]:bounds[i + 1]] for i in nodes])

    def _spread(self, query: np.ndarray, hits: np.ndarray, cosine: float) -> np.ndarray:
        """All nodes reached from the hits, along links or against them, over nodes near the query or a little farther."""
        seen = np.zeros(len(self.vectors) + 1, bool)
        seen[-1] = True
        seen[hits] = True
        edge, out = hits, [hits]
        while len(edge):
            near = np.unique(np.concatenate((self.layers[0][edge].ravel(), self._linking(edge))))
            near = near[(near >= 0) & ~seen[near]]
            seen[near] = True
            score = self.vectors[near] @ query
            out.append(near[score >= cosine])
            edge = near[score >= cosine - 0.02]
        return np.concatenate(out)

    def links(self, queries: np.ndarray, cosine: float, own: np.ndarray | None = None) -> list[np.ndarray]:
        """`within`, with the beam widened until an audit by brute force on AUDIT of the queries finds no link missing."""
        n, width = len(self.vectors), BEAM
        picked = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
        truth = (queries[picked] @ self.vectors.T >= cosine).sum(axis=1)
        while width < n:
            found = self.within(queries, cosine, width, own)
            if all(len(found[i]) >= t for i, t in zip(picked, truth)):
                return found
            width *= 2
        return [np.flatnonzero(self.vectors @ q >= cosine) for q in queries]

    def packed(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, vectors=self.vectors, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return held.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> "Graph":
        held = np.load(io.BytesIO(data))
        return cls(held["vectors"], [held[f"layer{k}"] for k in range(len(held.files) - 1)])


def unit(vectors: list) -> np.ndarray:
    """Rows of length 1, in double precision."""
    held = np.array([np.asarray(x, np.float64) for x in vectors])
    held = held / np.abs(held).max(axis=1, keepdims=True)
    return held / np.sqrt((held * held).sum(axis=1, keepdims=True))


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect the same nodes, without cycles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def embedding_duplicates(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Links between rows of one label with at least that cosine, one row per row of `embeddings`.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included),
    kept (vec_id = component_id).

    Rows with equal label and components are one class. The classes of a label and length are dealt to shards by
    hash, and each shard builds its graph; blocks of query vectors meet every shard of their label, MEETING of them
    in one task, which loads the graph once. Beams are widened
    until an audit finds all links; every link is verified in double precision. A block returns numbers of links and
    a forest of linked classes, never all pairs.

    Null label; null, empty or zero vectors, or null or non-finite components: no links, a component of their own. A
    null vec_id takes part, but is a component's id only if there is no other. Rows that repeat a vec_id are
    joined in components, and count as other rows in n_links. vec_id may be of any
    type with an order. Other columns are not looked at. Empty table: empty result.
    """
    small_batches(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # a class has a number of its own, as one vec_id may stand for several
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vector-classes")

    key = ["label", "length"]
    totals = classes.groupBy(*key).agg(F.count("*").alias("n"))
    totals = totals.withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = classes.join(totals, key).withColumn("hash", F.xxhash64("vector"))
    dealt = dealt.withColumn("shard", F.pmod("hash", "shards").cast("int")).withColumn("block", F.pmod(F.xxhash64("hash"), "blocks").cast("int"))
    kind = dict(classes.dtypes)["label"]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hash", ignore_index=True)
        graph = Graph.built(unit(group["vector"].tolist()))
        return pd.DataFrame({
            "label": [group["label"][0]], "length": [group["length"][0]], "shard": [group["shard"][0]], "graph": [graph.packed()],
            "nodes": [group["node"].to_numpy().tobytes()], "copies": [group["copies"].to_numpy().tobytes()]})

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "label": [group["label"][0]], "length": [group["length"][0]], "block": [group["block"][0]],
            "queries": [unit(group["vector"].tolist()).tobytes()], "asking": [group["node"].to_numpy().tobytes()]})

    graphs = dealt.groupBy(*key, "shard").applyInPandas(build, f"label {kind}, length int, shard int, graph binary, nodes binary, copies binary")
    blocks = dealt.groupBy(*key, "block").applyInPandas(packed, f"label {kind}, length int, block int, queries binary, asking binary")
    part = F.floor(F.col("block") / MEETING).cast("int")
    asked = blocks.join(totals, key).withColumn("part", part).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    last = F.floor((F.col("blocks") - 1) / MEETING).cast("int")
    answering = stored(graphs, "vector-graphs").join(totals, key).withColumn("part", F.explode(F.sequence(F.lit(0), last)))

    def search(graph: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})]
        if len(graph) and len(blocks):
            held, nodes, copies = Graph.unpacked(graph["graph"][0]), *(np.frombuffer(graph[c][0], np.int64) for c in ("nodes", "copies"))
            place = {n: i for i, n in enumerate(nodes.tolist())}
            for row in blocks.sort_values("block").itertuples(index=False):
                asking = np.frombuffer(row.asking, np.int64)
                own = np.array([place.get(n, -1) for n in asking.tolist()])
                found = held.links(np.frombuffer(row.queries).reshape(len(asking), row.length), cosine, own)
                counts = np.array([copies[x].sum() for x in found], np.int64)
                pairs = forest([(int(q), int(nodes[j])) for q, x in zip(asking, found) for j in x if nodes[j] != q])
                out.append(pd.DataFrame({"node": asking, "links": counts, "other": pd.Series([None] * len(asking), dtype="Int64")}))
                out.append(pd.DataFrame({"node": [a for a, _ in pairs], "links": 0, "other": pd.Series([b for _, b in pairs], dtype="Int64")}))
        return pd.concat(out)

    place = [*key, "shard", "part"]
    found = answering.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search, "node long, links long, other long")
    found = stored(found, "vector-links")
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # the vectors of rows that share a vec_id are one in components
    owned = rows.where("sound and vec_id is not null").join(classes.select("label", "vector", "node"), ["label", "vector"]).select("vec_id", "node").distinct()
    several = owned.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").drop("most")
    one = owned.join(several, "vec_id").where("a < node").select("a", F.col("node").alias("b"))
    joined = components(links.union(one), "vector-components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = classes.join(counts, "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = ids.join(smallest, "component").select("label", "vector", "links", "component_id")
    good = rows.where("sound").join(ids, ["label", "vector"]).select("vec_id", (F.col("links") - 1).alias("n_links"), "component_id")
    lone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
