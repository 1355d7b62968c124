"""Near-duplicate embeddings: NN-descent over representatives of tight balls.

1. Equal vectors form a class. Distinct vectors are sorted by the signs of random
   projections, and within short runs of that order each vector within the angle
   `BALL` of an earlier leader joins it. A large group of near copies becomes few
   balls, and the members of a ball are linked with each other by the triangle
   inequality: no pair of them is made.
2. NN-descent over the leaders. Runs of several random orders give first neighbour
   lists; each round joins the neighbours of every leader with each other, and both
   ends take what is closer. Lists hold `NEIGHBOURS` entries, and all those close
   enough for a link of any members, so saturated lists grow. Rounds end when
   hardly any close pair is new.
3. Audit: beside the leaders the search gets `AUDITED` planted vectors, each just
   within a link of one leader in a random direction, so that there are always hard,
   isolated links to be found. Also `AUDITED` vectors (`AUDITED_MOST` if that shows
   fewer than `ENOUGH` pairs of balls) are compared with all others, and the pairs of
   balls that their links join are looked for. While either recall is below `RECALL`,
   the lists get more random orders, in doubling numbers, and further rounds. If it is
   not met after `ATTEMPTS`, the operator raises.
4. Pairs of leaders whose balls can hold a link: if all members must be linked,
   their numbers are added up; else blocks of members are compared, in double
   precision, and counts leave the task. Threshold: cosine >= 0.9.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing: n_links 0, alone, kept. Vectors link with equally long
ones only; the length is the first key of every order, so lengths do not mix.
Repeated rows are copies of one vector and linked with each other. A null vec_id
leads no component unless all its ids are null. Ties go to the smallest id. An empty
table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postulant.llm.common import components, parts, table, written

LEAST = 0.9
ANGLE = acos(LEAST)
BALL = radians(12.4)  # less than half the angle of a link
SURE = 1e-7  # angles closer to a decision than this are decided by members
NEIGHBOURS = 8
OFFERED = 3  # best new neighbours that one join offers each end, beside all close ones
ORDERS = 4
MOST_ROUNDS = 5
AUDITED, AUDITED_MOST, ENOUGH = 256, 1024, 200
ATTEMPTS = 7  # 4, 4, 8, ... 128 orders
RECALL = 0.98
RUN, BLOCK = 128, 256


def _stack(raw: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of equally long raw vectors."""
    v = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(raw: pa.Array) -> Iterator[pa.Array]:
    """The places of the raw vectors of each length, in order: vectors are compared with equally long ones only."""
    sizes = np.array([len(x) for x in raw.to_pylist()])
    for size in np.unique(sizes):
        yield pa.array(np.flatnonzero(sizes == size))


def read(df: DataFrame) -> DataFrame:
    """row, vec_id and the raw vector, null where it can have no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for i in range(batch.num_rows):
                x = batch.column(2)[i]
                v = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) and not x.values.null_count else None
                good = v is not None and np.isfinite(v).all() and np.any(v)
                raw.append(v.astype(np.float32).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["row", "vec_id", "raw"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(run, "row long, vec_id long, raw binary")


def ordered(nodes: DataFrame, seed: int, count: int, planes_used: int = 24) -> DataFrame:
    """node and raw, dealt in ranges of a random order in which vectors of one length, and of them close ones, tend to lie side by side."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for places in _by_length(batch.column(1)):
                part = batch.take(places)
                v = _stack(part.column(1))
                planes = np.random.default_rng(seed).standard_normal((v.shape[1], planes_used))
                bits = (v @ planes > 0) @ (1 << np.arange(planes_used - 1, -1, -1, dtype=np.int64))
                length = pa.array(np.full(len(v), v.shape[1]))
                yield pa.RecordBatch.from_arrays([*part.columns, length, pa.array(bits)], ["node", "raw", "length", "code"])

    coded = nodes.select("node", "raw").mapInArrow(code, "node long, raw binary, length long, code long")
    n = parts(nodes, 50_000, count)
    return coded.repartitionByRange(n, "length", "code", "node").sortWithinPartitions("length", "code", "node")


def balls(nodes: DataFrame, seed: int, count: int, radius: float) -> DataFrame:
    """(node, leader, angle): each vector with a leader at most `radius` away, itself if there is none."""
    least = cos(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                for places in _by_length(rows.column(1)):
                    part = rows.take(places)
                    v = _stack(part.column(1))
                    near = v @ v.T
                    leader = np.full(len(v), -1)
                    for i in range(len(v)):
                        if leader[i] < 0:
                            leader[(leader < 0) & (near[i] >= least)] = i
                            leader[i] = i
                    node = part.column(0).to_numpy()
                    apart = np.arccos(np.clip(near[np.arange(len(v)), leader], -1, 1)) + 1e-7 * (leader != np.arange(len(v)))
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[leader]), pa.array(apart)], ["node", "leader", "angle"])

    planes = min(24, max(1, int(np.log2(max(2, count // 256)))))  # about half a run for each cell
    return ordered(nodes, seed, count, planes).mapInArrow(run, "node long, leader long, angle double")


def _offers(node: np.ndarray, near: np.ndarray, close: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a matrix of similarities: for each row the `most` best others and all that are close."""
    np.fill_diagonal(near, -2)
    take = near >= close
    if len(node) > 1:
        best = np.argpartition(-near, min(most, len(node) - 1) - 1, axis=1)[:, :most]
        take[np.arange(len(node))[:, None], best] = True
    np.fill_diagonal(take, False)
    i, j = np.nonzero(take)
    return node[i], node[j], near[i, j]


EDGES = "a long, b long, near double"


def _batch(offers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*offers, strict=True)] if offers else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "near"])


def first_lists(nodes: DataFrame, seed: int, count: int, close: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN // 2):  # runs overlap by half
                rows = batch.slice(at, RUN)
                for places in _by_length(rows.column(1)):
                    part = rows.take(places)
                    v = _stack(part.column(1))
                    yield _batch([_offers(part.column(0).to_numpy(), v @ v.T, close, NEIGHBOURS)])

    return ordered(nodes, seed, count).mapInArrow(run, EDGES)


def kept_lists(offers: DataFrame, close: float) -> DataFrame:
    """Of all offers the `NEIGHBOURS` best per node and every close one."""
    distinct = offers.groupBy("a", "b").agg(F.max("near").alias("near"))
    ranked = distinct.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("near"), "b")))
    return ranked.where((F.col("place") <= NEIGHBOURS) | (F.col("near") >= close)).drop("place")


def joined_neighbours(lists: DataFrame, nodes: DataFrame, close: float) -> DataFrame:
    """Offers from comparing all neighbours of each node, in either direction, with each other.

    The reverse list takes the closest 2 x `NEIGHBOURS`, which only steers the search.
    """
    back = lists.select(F.col("b").alias("hub"), F.col("a").alias("node"), "near")
    ranked = back.withColumn("place", F.row_number().over(W.partitionBy("hub").orderBy(F.desc("near"), "node")))
    reverse = ranked.where(F.col("place") <= 2 * NEIGHBOURS).select("hub", "node")
    around = lists.select(F.col("a").alias("hub"), F.col("b").alias("node")).union(reverse).distinct()
    with_vectors = around.join(nodes.select("node", "raw"), "node").select("hub", "node", "raw")

    def within(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for places in _by_length(table.column("raw")):  # all around a hub are as long as it
            rows = table.take(places)
            hub, node = rows.column("hub").to_numpy(), rows.column("node").to_numpy()
            v = _stack(rows.column("raw").combine_chunks())
            new = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
            yield _batch([_offers(node[a:b], v[a:b] @ v[a:b].T, close, OFFERED) for a, b in zip(new, [*new[1:], len(hub)], strict=True) if b - a > 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
            if not rows.num_rows:
                continue
            hubs = rows.column("hub").to_numpy()
            start = int(np.argmax(hubs == hubs[-1]))
            if start:
                yield from within(rows.slice(0, start))
            carried = rows.slice(start)
        if carried is not None and carried.num_rows:
            yield from within(carried)

    return with_vectors.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, EDGES)


def planted(nodes: DataFrame) -> DataFrame:
    """(node, raw) of a vector just within a link of each of `AUDITED` nodes; that of node x is named -1 - x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raw = [], []
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = _stack(pa.array([value], pa.binary()))[0]
                if len(v) < 2:
                    continue
                side = np.random.default_rng(node).standard_normal(len(v))
                side -= (side @ v) * v
                side /= np.linalg.norm(side)
                names.append(-1 - node)
                raw.append((cos(0.999 * ANGLE) * v + sin(0.999 * ANGLE) * side).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(raw, pa.binary())], ["node", "raw"])

    chosen = nodes.select("node", "raw").orderBy(F.xxhash64("node")).limit(AUDITED)
    return chosen.mapInArrow(run, "node long, raw binary")


def audit(members: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of balls that links of `most` members join, by comparing these with every member."""
    asked = members.orderBy(F.xxhash64("node")).limit(most).select("leader", "raw").collect()  # a fixed number
    names, raw = np.array([r.leader for r in asked], np.int64), pa.array([bytes(r.raw) for r in asked], pa.binary())
    queries = {v.shape[1]: (names[places.to_numpy()], v) for places in _by_length(raw) for v in [_stack(raw.take(places))]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in _by_length(batch.column(1)):
                part = batch.take(places)
                leader, v = part.column(0).to_numpy(), _stack(part.column(1))
                if v.shape[1] in queries:
                    mine, q = queries[v.shape[1]]
                    i, j = np.nonzero((q @ v.T >= LEAST) & (mine[:, None] != leader[None, :]))
                    found = np.unique(np.stack([mine[i], leader[j]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return members.select("leader", "raw").mapInArrow(run, "a long, b long").distinct()


def search(heads: DataFrame, members: DataFrame, count: int, close: float) -> tuple[DataFrame, dict[str, float]]:
    """Pairs (a, b) of heads at least `close`, both ways round, and the audited recalls, which are met."""
    probes = written(planted(heads), "planted")
    nodes = written(heads.select("node", "raw").union(probes), "searched")
    linked = written(audit(members, AUDITED), "audit")
    if linked.count() < ENOUGH:
        linked = written(audit(members, AUDITED_MOST), "audit")
    truth = {"planted": probes.select((-1 - F.col("node")).alias("a"), F.col("node").alias("b")), "linked": linked}
    wanted = {k: t.count() for k, t in truth.items()}
    offers, seed, more = None, 100, ORDERS
    recall = dict.fromkeys(truth, 0.0)
    for _ in range(ATTEMPTS):
        for s in range(seed, seed + more):
            added = first_lists(nodes, s, count, close)
            offers = added if offers is None else offers.union(added)
        more, seed = seed + more - 100, seed + more  # as many again as there were
        lists = written(kept_lists(offers, close), "lists")
        known = lists.where(F.col("near") >= close).count()
        for _ in range(MOST_ROUNDS):
            lists = written(kept_lists(lists.union(joined_neighbours(lists, nodes, close)), close), "lists")
            before, known = known, lists.where(F.col("near") >= close).count()
            if known - before <= before // 1000:
                break
        near = lists.where(F.col("near") >= close)
        pairs = written(near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")
        recall = {k: pairs.join(t, ["a", "b"], "left_semi").count() / wanted[k] if wanted[k] else 1.0 for k, t in truth.items()}
        if min(recall.values()) >= RECALL:
            return pairs.where("a >= 0 and b >= 0"), recall
        offers = lists
    raise ArithmeticError(f"links incomplete after {ATTEMPTS} attempts: recall {recall} of {wanted}, {RECALL} needed")


def _compared(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, node, n): links of each member of ball a with members of ball b, counted with copies, by comparing blocks."""
    block = F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1))).cast("int")
    packed = members.join(pairs.select(F.col("a").alias("leader")).distinct(), "leader", "left_semi")
    packed = packed.withColumn("block", block).groupBy("leader", "block").agg(F.sort_array(F.collect_list(F.struct("node", "copies", "raw"))).alias("rows"))
    packed = written(packed, "blocks")  # about BLOCK members each
    left = packed.select(F.col("leader").alias("a"), F.col("rows").alias("ra"))
    right = packed.select(F.col("leader").alias("b"), F.col("rows").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ra, rb = (batch.column(c)[i].values for c in (2, 3))
                linked = _stack(ra.field("raw")) @ _stack(rb.field("raw")).T >= LEAST
                n = linked @ rb.field("copies").to_numpy()
                out += [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), node, int(x)) for node, x in zip(ra.field("node").to_pylist(), n, strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], ["a", "b", "node", "n"])

    dealt = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
    return dealt.mapInArrow(run, "a long, b long, node long, n long")


def near_duplicates(df: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with vec_id and embedding."""
    rows = written(read(df), "vectors")
    usable = rows.where("raw is not null")
    distinct = written(usable.groupBy("raw").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first")), "distinct")
    count = distinct.count()

    placed = balls(distinct, 1, count, BALL)
    members = written(placed.join(distinct, "node"), "members")
    ball = written(members.groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("size"), F.min("first").alias("first")), "ball")
    heads = written(distinct.select("node", "raw").join(ball.select(F.col("leader").alias("node")), "node", "left_semi"), "heads")

    close = cos(ANGLE + 2 * (ball.agg(F.max("radius")).first()[0] or 0.0) + SURE)
    pairs, _ = search(heads, members, ball.count(), close)  # raises below RECALL

    def side(name: str) -> DataFrame:
        return heads.withColumnRenamed("node", name).withColumnRenamed("raw", f"raw_{name}").join(
            ball.select(F.col("leader").alias(name), F.col("radius").alias(f"r_{name}"), F.col("weight").alias(f"w_{name}")), name
        )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in _by_length(batch.column(2)):
                part = batch.take(places)
                angle = np.arccos(np.clip((_stack(part.column(2)) * _stack(part.column(3))).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (0, 1, 4, 5)), pa.array(angle)], ["a", "b", "reach", "w_b", "angle"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b", (F.col("r_a") + F.col("r_b")).alias("reach"), "w_b")
    measured = written(both.mapInArrow(measure, "a long, b long, reach double, w_b long, angle double"), "measured")
    sure = measured.where(F.col("angle") + F.col("reach") <= ANGLE - SURE)
    open_pairs = measured.where((F.col("angle") + F.col("reach") > ANGLE - SURE) & (F.col("angle") - F.col("reach") <= ANGLE + SURE))
    counted = written(_compared(written(open_pairs.select("a", "b"), "open"), members.join(ball.select("leader", "size"), "leader")), "counted")

    of_leader = sure.groupBy(F.col("a").alias("leader")).agg(F.sum("w_b").alias("n_sure"))
    of_node = counted.groupBy("node").agg(F.sum("n").alias("n_open"))
    links = components(sure.select("a", "b").union(counted.select("a", "b")))
    part = ball.join(links.withColumnRenamed("node", "leader"), "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    smallest = part.groupBy("component").agg(F.min("first").alias("component_id"))
    of_ball = part.join(smallest, "component").join(of_leader, "leader", "left").select("leader", "weight", "component_id", F.coalesce("n_sure", F.lit(0)).alias("n_sure"))
    of_class = members.select("node", "leader", "raw").join(of_ball, "leader").join(of_node, "node", "left")
    n_links = F.col("weight") - 1 + F.col("n_sure") + F.coalesce("n_open", F.lit(0))
    found = written(of_class.select("raw", n_links.alias("n_links"), "component_id"), "found")
    result = rows.join(found, "raw", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


QUERIES = {"op1_embeddings": duplicates}
SQL = {
    "op1_embeddings": """WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id""",
}
