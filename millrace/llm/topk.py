"""Exact top-k search by inner product with a dual-tree over cover trees.

Queries and candidates are dealt to the nearest of some pivots, a bounded sample, and cut into
blocks there. A cover tree is built over each block: a node has a centre among its points and a
covering radius, and its children's centres lie further apart than their covering radius, a fixed
fraction of the parent's. For a pair of nodes,
    q . p <= cq . cp + |cq| rp + |cp| rq + rq rp
bounds every score between them; the pair is dropped when that is under the worst kth score of
the query node's queries. Other pairs are split, best bound first, down to leaves, which are
scored at once. A node whose points spread so evenly that children would hold hardly anything
stays a leaf; pruning, never the result, depends on it.

The same bound prunes whole blocks before any vector moves. Only roots (centre and radius of a
block) meet: first, each query block is searched in the FIRST candidate blocks of the best centres,
which gives its worst kth score; then the pairs of blocks are listed whose bound reaches that, and
only their candidate blocks are shuffled, once for each group of query blocks that wants them,
in `slots` streams. A query yields k rows a stream, whatever the number of candidates. Rows are
integers floor(scale * x), and scores exact: in double precision, 64-bit or Python integers, as
their size needs. A component or a score to return that 64 bits don't hold is an error.

Null vectors, vectors that hold null, NaN or infinities, and vectors without an id take no part.
Vectors of different length aren't compared. A row with the query's own id is no candidate of it;
repeated ids among candidates are kept, ordered as they score. Without candidates or queries the
result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tables
from millrace.llm.components import salted_join

BLOCK = 4096
QUERY_BLOCK = 2048
#: Query blocks that a candidate block is moved to at once.
GROUP = 32
SLOTS = 8
LEAF = 32
#: Vectors that blocks are formed around, at most.
PIVOTS = 256
#: Candidate blocks that give a query block its first kth scores.
FIRST = 2
#: A child's covering radius as a part of its parent's.
SHRINK = 0.75

_BLOCK_SCHEMA = "dim int, pivot int, sub long, block long, n int, ids binary, uids binary, points binary, nodes binary, radii binary, centre binary"


class CoverTree:
    """Nodes over points, which are reordered so that a node's points lie next to each other.

    nodes: rows of first point, point after the last, centre's place, first child, child after
    the last (both 0 in a leaf). A node's centre is its first point."""

    def __init__(self, points: np.ndarray):
        self.exact = points
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        nodes, radii = [[0, len(points), 0, 0, 0]], [self._radius(0, len(points))]
        at = 0
        while at < len(nodes):
            first, last = nodes[at][:2]
            parts = self._split(first, last, radii[at] * SHRINK) if last - first > LEAF else []
            if parts:
                nodes[at][3:] = [len(nodes), len(nodes) + len(parts)]
                for a, b in parts:
                    nodes.append([a, b, a, 0, 0])
                    radii.append(self._radius(a, b))
            at += 1
        self.nodes, self.radii = np.array(nodes, np.int64), np.array(radii)
        self.points, self.exact = self.points[self.order], self.exact[self.order]

    def _distances(self, centre: int, first: int, last: int) -> np.ndarray:
        x = self.points[self.order[first:last]] - self.points[self.order[centre]]
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def _radius(self, first: int, last: int) -> float:
        return float(self._distances(first, first, last).max()) if last > first else 0.0

    def _split(self, first: int, last: int, radius: float) -> list[tuple[int, int]]:
        """Greedy cover: a point joins the first centre within `radius`; [] if it isn't worth it."""
        parts, at = [], first
        while at < last:
            d = self._distances(at, at, last)
            near = d <= radius
            near[0] = True
            own = self.order[at:last]
            self.order[at:last] = np.concatenate((own[near], own[~near]))
            parts.append((at, at + int(near.sum())))
            at = parts[-1][1]
            if len(parts) >= 8 and (at - first) < 2 * len(parts):
                return []
        return parts if len(parts) > 1 else []


class Best:
    """The k best of each query: score, candidate id, in that order of preference. Scores under
    `floor`, which k candidates elsewhere reach, don't count. Scores are Python integers if `big`."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None, big: bool = False):
        self.k = k
        least = -(1 << 200) if big else np.iinfo(np.int64).min
        self.scores = np.full((n, k), least, object if big else np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)
        self.floor = np.full(n, least, self.scores.dtype) if floor is None else floor.astype(self.scores.dtype)

    def worst(self, first: int, last: int) -> int:
        return int(np.maximum(self.scores[first:last, -1], self.floor[first:last]).min())

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores: of queries first.. against candidates ids."""
        n = len(scores)
        row, col = np.nonzero(allowed & (scores >= np.maximum(self.scores[first : first + n, -1:], self.floor[first : first + n, None])))
        if not len(row):
            return
        touched = np.unique(row)
        had = first + touched
        rows = np.concatenate((np.repeat(touched, self.k), row))
        s = np.concatenate((self.scores[had].ravel(), scores[row, col]))
        i = np.concatenate((self.ids[had].ravel(), ids[col]))
        real = np.concatenate((np.arange(self.k) < self.full[had][:, None], np.ones((len(row), 1), bool).reshape(-1, 1)), axis=None)
        rows, s, i = rows[real], s[real], i[real]
        order = np.lexsort((i, -s, rows)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda x: (rows[x], -s[x], i[x])))
        rows, s, i = rows[order], s[order], i[order]
        begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(rows)]))))
        keep = rank < self.k
        self.scores[first + rows[keep], rank[keep]] = s[keep]
        self.ids[first + rows[keep], rank[keep]] = i[keep]
        self.full[had] = np.bincount(rows[keep], minlength=n)[touched]


def _bounds(dot: np.ndarray, norm_q: np.ndarray, rq: np.ndarray, norm_p: np.ndarray, rp: np.ndarray) -> np.ndarray:
    """Upper bounds of scores between balls; the slack is that of rounding at this magnitude."""
    ub = dot + norm_q[:, None] * rp + rq[:, None] * norm_p + rq[:, None] * rp
    return ub + 1e-9 * (norm_q + rq)[:, None] * (norm_p + rp) + 1e-6


def largest_score(q: np.ndarray, p: np.ndarray) -> int:
    """No inner product of these integer vectors is larger."""
    return int(np.abs(q).max(initial=0)) * int(np.abs(p).max(initial=0)) * q.shape[1]


def dual_search(q: CoverTree, q_ids: np.ndarray, p: CoverTree, p_ids: np.ndarray, best: Best) -> int:
    """Scores what can't be pruned; returns the number of scores computed."""
    norms_q = np.sqrt((q.points[q.nodes[:, 2]] ** 2).sum(axis=1))
    norms_p = np.sqrt((p.points[p.nodes[:, 2]] ** 2).sum(axis=1))
    large = largest_score(q.exact, p.exact)
    exact = np.float64 if large < 2**53 else np.int64 if large < 2**63 else object

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _bounds(q.points[q.nodes[a, 2]] @ p.points[p.nodes[b, 2]].T, norms_q[a], q.radii[a], norms_p[b], p.radii[b])

    done = 0
    heap = [(-bounds(np.array([0]), np.array([0]))[0, 0], 0, 0)]
    while heap:
        ub, a, b = heapq.heappop(heap)
        qa, qb, _, qc, qd = q.nodes[a].tolist()
        if -ub < best.worst(qa, qb):
            continue
        pa_, pb, _, pc, pd = p.nodes[b].tolist()
        if qc == 0 and pc == 0:
            x, y = (q.points[qa:qb], p.points[pa_:pb]) if exact is np.float64 else (q.exact[qa:qb].astype(exact), p.exact[pa_:pb].astype(exact))
            scores = (x @ y.T).astype(best.scores.dtype)
            best.add(qa, p_ids[pa_:pb], scores, q_ids[qa:qb, None] != p_ids[pa_:pb])
            done += scores.size
            continue
        split_q = qc and (pc == 0 or q.radii[a] > p.radii[b])
        left, right = (np.arange(qc, qd), np.array([b])) if split_q else (np.array([a]), np.arange(pc, pd))
        for i, row in zip(left.tolist(), bounds(left, right).tolist(), strict=True):
            low = best.worst(*q.nodes[i, :2].tolist())
            for j, u in zip(right.tolist(), row, strict=True):
                if u >= low:
                    heapq.heappush(heap, (-u, i, j))
    return done


def _pivots(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """By dimension, at most `most` vectors in all, in the order of a walk to the next nearest."""
    rows = vectors.orderBy(F.xxhash64("uid", "vec_id"), "uid").limit(most).select("dim", "ints").collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        x = np.array([r["ints"] for r in rows if r["dim"] == dim], float).reshape(-1, dim)
        for i in range(1, len(x)):
            near = i + int(((x[i:] - x[i - 1]) ** 2).sum(axis=1).argmin())
            x[[i, near]] = x[[near, i]]
        out[dim] = x
    return out


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Adds `pivot`, the nearest of the vector's dimension, and `sub`, a part of about `size` of its vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, ints = batch.column("dim").to_numpy(), batch.column("ints")
            pivot = np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                if d and d in shared.value:
                    own, c = np.flatnonzero(dim == d), shared.value[d]
                    x = ints.take(pa.array(own)).flatten().to_numpy().reshape(-1, d).astype(float)
                    pivot[own] = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], [*batch.schema.names, "pivot"])

    schema = vectors.withColumn("pivot", F.lit(0)).schema
    near = tables.saved(vectors.mapInArrow(run, schema), "placed")
    parts = near.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    # As many rows as pivots at most for each dimension; a pivot's vectors may be many.
    keyed = near.withColumn("place", F.struct("dim", "pivot"))
    return salted_join(keyed, parts.select(F.struct("dim", "pivot").alias("place"), "parts"), "place", "uid").withColumn("sub", F.pmod(F.xxhash64("uid", "vec_id"), F.col("parts"))).drop("place", "parts")


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """A row per block: its cover tree. `vectors`: uid, vec_id, ints, dim, pivot, sub."""
    names = [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, part = None, [], 0, 0

        def close() -> pa.RecordBatch:
            uids, ids, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            points = flat.reshape(len(ids), -1) if now[0] else np.zeros((len(ids), 0), np.int64)
            order = np.lexsort((uids, ids))
            tree = CoverTree(points[order])
            order = order[tree.order]
            block = (now[1] << 46) + (now[2] << 10) + part
            cells = [*now, block, len(ids), ids[order].tobytes(), uids[order].tobytes(), _narrow(tree.exact), tree.nodes.tobytes(), tree.radii.tobytes(), tree.points[0].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "pivot", "sub")], axis=1)
            uid, ids, ints = batch.column("uid").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("ints")
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    key = tuple(keys[a].tolist())
                    if held and (now != key or n >= 2 * size):
                        yield close()
                        part = part + 1 if now == key else 0
                        held, n = [], 0
                    now, to = key, min(b, a + 2 * size - n)
                    held.append((uid[a:to], ids[a:to], ints.slice(a, to - a).flatten().to_numpy()))
                    n += to - a
                    a = to
        if held:
            yield close()

    dealt = vectors.select("uid", "vec_id", "ints", "dim", "pivot", "sub")
    return dealt.repartition(tables.partitions(vectors.sparkSession), "dim", "pivot", "sub").sortWithinPartitions("dim", "pivot", "sub").mapInArrow(run, _BLOCK_SCHEMA)


def _narrow(points: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all; the first byte says how many."""
    most = int(np.abs(points).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << 8 * w - 1)
    return bytes([width]) + points.astype(f"<i{width}").tobytes()


def _tree(row: dict) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    t = object.__new__(CoverTree)
    t.exact = np.frombuffer(row["points"], f"<i{row['points'][0]}", offset=1).reshape(row["n"], row["dim"]).astype(np.int64)
    t.points = t.exact.astype(np.float64)
    t.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 5)
    t.radii = np.frombuffer(row["radii"], np.float64)
    return t, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64)


def integers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, ints: floor(scale * x) of usable vectors."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    big = F.raise_error(F.lit("a component is beyond 64-bit integers")).cast("long")
    scaled = F.transform(x, lambda v: F.lit(float(scale)) * v.cast("double"))
    ints = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0**63, F.floor(v)).otherwise(big))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints"))


def _meet(q: DataFrame, p: DataFrame, judge, schema: str) -> DataFrame:
    """Roots of all candidate blocks come to the roots of each group of query blocks. `judge` maps the
    query roots (a list of rows) to a function of (candidate roots) -> record batch or None, and one at the end."""
    roots_p = p.select("dim", "block", "radii", "centre")
    groups = q.select("dim", "grp").distinct()
    spread = salted_join(roots_p, groups, "dim", "block").select("dim", "grp", F.lit(1).alias("kind"), "block", F.lit(0.0).alias("worst"), F.substring("radii", 1, 8).alias("radius"), "centre", F.lit(None).cast("array<long>").alias("seen"))
    own = q.select("dim", "grp", F.lit(0).alias("kind"), "block", "worst", F.substring("radii", 1, 8).alias("radius"), "centre", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, judged = None, [], None

        def roots(rows: list[dict]) -> tuple:
            c = np.array([np.frombuffer(r["centre"], np.float64) for r in rows])
            return [r["block"] for r in rows], c, np.sqrt((c**2).sum(axis=1)), np.array([np.frombuffer(r["radius"], np.float64)[0] for r in rows])

        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                to = at
                first = (rows[at]["dim"], rows[at]["grp"], rows[at]["kind"])
                while to < len(rows) and (rows[to]["dim"], rows[to]["grp"], rows[to]["kind"]) == first:
                    to += 1
                if first[:2] != now:
                    if judged:
                        yield from judged(None)
                    now, held, judged = first[:2], [], None
                if first[2] == 0:
                    held += rows[at:to]
                else:
                    judged = judged or judge(now, held, roots(held))
                    yield from judged(roots(rows[at:to]))
                at = to
        if judged:
            yield from judged(None)

    return own.unionByName(spread).repartition("dim", "grp").sortWithinPartitions("dim", "grp", "kind").mapInArrow(run, schema)


_PAIR = "dim int, grp long, block long, wanted array<long>"


def _pairs(dim: list, grp: list, block: list, wanted: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(grp, pa.int64()), pa.array(block, pa.int64()), pa.array(wanted, pa.list_(pa.int64()))], ["dim", "grp", "block", "wanted"])


def nearest_blocks(q: DataFrame, p: DataFrame, count: int = FIRST) -> DataFrame:
    """For each query block the candidate blocks of the best centres: dim, grp, block, wanted (query blocks)."""

    def judge(key, held, roots_q):
        names, centres, _, _ = roots_q
        best = [[] for _ in names]

        def take(roots_p):
            if roots_p is not None:
                dots = centres @ roots_p[1].T
                for own, row in zip(best, dots.tolist(), strict=True):
                    own += zip(row, roots_p[0], strict=True)
                    own.sort(reverse=True)
                    del own[count:]
                return
            wanted: dict[int, list[int]] = {}
            for name, own in zip(names, best, strict=True):
                for _, block in own:
                    wanted.setdefault(block, []).append(name)
            yield _pairs([key[0]] * len(wanted), [key[1]] * len(wanted), list(wanted), list(wanted.values()))

        return lambda roots_p: take(roots_p) or ()

    return _meet(q, p, judge, _PAIR)


def reachable_blocks(q: DataFrame, p: DataFrame) -> DataFrame:
    """All pairs of blocks whose bound reaches the query block's worst kth score, but for those seen."""

    def judge(key, held, roots_q):
        names, centres, norms, radii = roots_q
        worst = np.array([r["worst"] for r in held])
        seen = [set(r["seen"] or ()) for r in held]

        def take(roots_p):
            if roots_p is None:
                return
            blocks, c, norms_p, radii_p = roots_p
            reach = _bounds(centres @ c.T, norms, radii, norms_p, radii_p) >= worst[:, None]
            some = np.flatnonzero(reach.any(axis=0)).tolist()
            wanted = [[names[i] for i in np.flatnonzero(reach[:, j]).tolist() if blocks[j] not in seen[i]] for j in some]
            kept = [(blocks[j], x) for j, x in zip(some, wanted, strict=True) if x]
            if kept:
                yield _pairs([key[0]] * len(kept), [key[1]] * len(kept), [b for b, _ in kept], [x for _, x in kept])

        return take

    return _meet(q, p, judge, _PAIR)


def search(q: DataFrame, p: DataFrame, pairs: DataFrame, k: int, slots: int) -> DataFrame:
    """Searches the pairs of blocks: a row per query block and slot with its queries' best."""
    moved = p.drop("pivot", "sub").join(pairs, ["dim", "block"]).withColumns({"kind": F.lit(1), "slot": F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"), "floor": F.lit(None).cast("binary")})
    own = q.withColumns({"kind": F.lit(0), "slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1))), "wanted": F.lit(None).cast("array<long>")}).select(moved.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            for block, (_, ids, uids, best) in groups.items():
                row, col = np.nonzero(np.arange(k) < best.full[:, None])
                scores = best.scores[row, col]
                if scores.dtype == object:
                    if any(not -(2**63) <= s < 2**63 for s in scores.tolist()):
                        raise OverflowError("a score is beyond 64-bit integers")
                    scores = scores.astype(np.int64)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), now[0], np.int32)), pa.array(np.full(len(row), block)), pa.array(uids[row]), pa.array(ids[row]), pa.array(best.ids[row, col]), pa.array(scores)], ["dim", "block", "q_uid", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = (row["dim"], row["grp"], row["slot"])
                if key != now:
                    yield from close()
                    now, groups = key, {}
                tree, ids, uids = _tree(row)
                if row["kind"] == 0:
                    groups[row["block"]] = (tree, ids, uids, Best(len(ids), k, None if row["floor"] is None else np.frombuffer(row["floor"], np.int64)))
                    continue
                for block in row["wanted"]:
                    q_tree, q_ids, q_uids, best = groups[block]
                    if best.scores.dtype != object and largest_score(q_tree.exact, tree.exact) >= 2**63:
                        grown = Best(len(q_ids), k, best.floor, big=True)
                        grown.scores[best.full[:, None] > np.arange(k)] = best.scores[best.full[:, None] > np.arange(k)].tolist()
                        grown.ids, grown.full = best.ids, best.full
                        best = grown
                        groups[block] = (q_tree, q_ids, q_uids, best)
                    dual_search(q_tree, q_ids, tree, ids, best)
        yield from close()

    keys = ["dim", "grp", "slot"]
    met = own.unionByName(moved).repartition(tables.partitions(q.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "block")
    return met.mapInArrow(run, "dim int, block long, q_uid long, query_id long, vec_id long, score long")


def _floors(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """`worst` and `floor` of each query block: the least kth score found, and each query's."""
    kth = Window.partitionBy("dim", "block", "q_uid").orderBy(F.desc("score"), "vec_id")
    last = found.withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("q_uid", "score")).alias("kths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, worst = [], []
            for uids, kths in zip(batch.column("uids").to_pylist(), batch.column("kths").to_pylist(), strict=True):
                known = {x["q_uid"]: x["score"] for x in kths or ()}
                own = np.array([known.get(u, np.iinfo(np.int64).min) for u in np.frombuffer(uids, np.int64).tolist()], np.int64)
                floors.append(own.tobytes())
                worst.append(float(own.min()))
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("kths", "worst", "floor")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(worst), pa.array(floors, pa.binary())], [*(c for c in batch.schema.names if c not in ("kths", "worst", "floor")), "worst", "floor"])

    out = blocks.drop("worst", "floor").join(last, ["dim", "block"], "left")
    return out.mapInArrow(run, blocks.drop("worst", "floor").withColumns({"worst": F.lit(0.0), "floor": F.lit(b"")}).schema)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, slots: int = SLOTS, log: dict | None = None) -> DataFrame:
    """The k candidates of the highest inner product for each query; both as from integers().
    Returns query_id, rank, vec_id, score. `log` takes the numbers of block pairs listed and possible."""
    ready = [tables.saved(x.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("ints")), "vectors") for x in (candidates, queries)]
    n_p, n_q = (x.count() for x in ready)
    if not n_p or not n_q:
        return ready[1].select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    pivots = _pivots(ready[0], min(PIVOTS, max(1, -(-n_p // block))))
    p, q = (tables.saved(_blocks(_placed(x, pivots, size), size), "blocks") for x, size in zip(ready, (block, query_block), strict=True))
    n_blocks = q.count()
    # Groups of neighbouring pivots, and of the parts of one pivot.
    groups = min(PIVOTS, max(1, n_blocks // GROUP))
    grp = F.floor(F.col("pivot") * groups / max(1, max(map(len, pivots.values())))) * (1 << 32) + F.floor(F.col("sub") / GROUP)
    q = q.withColumn("grp", grp.cast("long")).drop("pivot", "sub").withColumns({"worst": F.lit(float("-inf")), "floor": F.lit(None).cast("binary"), "seen": F.lit(None).cast("array<long>")})
    first = tables.saved(nearest_blocks(q, p), "pairs")
    found = tables.saved(search(q.drop("worst", "seen"), p, first, k, slots), "found")
    seen = first.select("dim", F.explode("wanted").alias("q"), "block").groupBy("dim", F.col("q").alias("block")).agg(F.collect_set("block").alias("seen"))
    q = tables.saved(_floors(q.drop("seen").join(seen, ["dim", "block"], "left"), found, k), "queries")
    pairs = tables.saved(reachable_blocks(q, p), "pairs")
    if log is not None:
        log |= {"listed": pairs.select(F.sum(F.size("wanted"))).first()[0] or 0, "first": first.select(F.sum(F.size("wanted"))).first()[0], "possible": n_blocks * p.count()}
    rest = search(q.drop("worst", "seen"), p, pairs, k, slots)
    order = Window.partitionBy("q_uid", "query_id").orderBy(F.desc("score"), "vec_id")
    columns = ["q_uid", "query_id", "vec_id", "score"]
    return found.select(columns).unionByName(rest.select(columns)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integers(tables.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
