"""Near-duplicates of embeddings by NN-descent.

Rows with equal label and equal vector are one node from the start, with their number as its weight.
Nodes are compared when their labels are equal (and their vectors as long), by cosine.

1. First lists: all nodes are sorted by label and by the signs of random projections, in several
   independent orders. Runs of ``leaf`` neighbours in an order are compared among themselves, and a node
   starts with the best of them.
2. Descent: in each round a node compares its neighbours, and those whose neighbour it is, with each
   other (pairs of which one is new since the last round), and whoever is closer than the last of a
   node's list is offered to it. Nodes meet in buckets by a hash of their id; neighbours travel as
   sketches of a byte a dimension. Who names a node is thinned to ``reverse`` rows before they meet,
   so a node that is named by very many is no large group.
3. A list that is full of partners over the threshold is saturated and grows, up to ``most_listed``.
   Pairs over the threshold that find no room are kept as links as well, some a node and round.
4. Rounds end when hardly any new partner is found. Pairs near or over the threshold are verified on
   the vectors in double precision; they connect nodes to groups.
5. Saturated lists stop growing there, so the rest of their partners is counted exactly: in each group
   all nodes are compared with all, in tiles of ``tile`` by ``tile`` nodes; a tile gives a sum a node, no
   pairs. A link can be missed only if nothing connects its two ends.
6. Audit: a fixed number of nodes, by a hash, is compared with every node. Links whose ends are in
   different groups were missed; below ``recall`` the descent goes on with lists and leaves twice as long
   and new orders (leaves as long as a label's nodes would compare all, so this ends). What the audit
   finds is added.

Vectors that are null, empty, of length zero, or that hold null or non-finite entries, and vectors with a
null label, link with nothing. Rows that share ``vec_id`` are vectors of their own. Null ids count as
vectors; a group of null ids only has a null id. An empty table gives no rows. Other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import lean, stored
from rosterlab.llm.graph import components

SELF, ENTRY, REVERSE, OFFER, LINK = range(5)
_FLOW = "what int, node bigint, member bigint, sim float, fresh boolean, kth float, sketch binary"
_NOTHING = -2.0  # below every cosine


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.93
    margin: float = 0.03  # sketches may be off by as much
    list_size: int = 8
    most_listed: int = 64
    reverse: int = 8
    orders: int = 4
    leaf: int = 32
    spare_links: int = 2  # links without room in a list that a node keeps a round
    ended: float = 0.005  # new partners of a round, as a share of all, at which rounds end
    bucket: int = 2048  # nodes that meet in a group
    tile: int = 1024
    audited: int = 512
    recall: float = 0.99
    seed: int = 12


@dataclass(frozen=True)
class Found:
    nodes: DataFrame  # node, kind, vector, least, weight, and two hashes of the vector
    edges: DataFrame  # u, v: verified links that connect groups
    members: DataFrame  # node, component; nodes without links are left out
    recall: float  # share of the audited nodes' links that the descent itself found


def keyed_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, kind (a hash of label and length; null if the row links with nothing), vector, two hashes."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").alias("_label"),
        # + 0 makes a negative zero a zero.
        F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0)).alias("vector"),
    )
    fits = F.forall("vector", lambda c: F.coalesce(finite(c), F.lit(False)))
    usable = F.col("_label").isNotNull() & fits & F.exists("vector", lambda c: c != 0)
    return own.select(
        "vec_id",
        F.when(usable, F.xxhash64("_label", F.size("vector"))).alias("kind"),
        "vector",
        F.when(usable, F.xxhash64("vector")).alias("_a"),
        F.when(usable, F.xxhash64(F.lit(1), "vector")).alias("_b"),
    )


def distinct_nodes(rows: DataFrame) -> DataFrame:
    grouped = (
        rows.where("kind IS NOT NULL")
        .groupBy("kind", "vector")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    )
    named = grouped.withColumns({"_a": F.xxhash64("vector"), "_b": F.xxhash64(F.lit(1), "vector")})
    return stored(named.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")


def units(column: pa.Array) -> np.ndarray:
    """Unit vectors, as rows; all of one length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector in a batch."""
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, units(batch.column(column).take(pa.array(at)))


def sketches(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def directions(column: list[bytes]) -> np.ndarray:
    """Unit vectors of sketches."""
    rows = np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1).astype(np.float32)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the last first, and each row's rank within equal values of the last key."""
    order = np.lexsort(keys)
    group = keys[-1][order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order, rank


def flow(what, node, member, sim=None, fresh=None, kth=None, sketch=None) -> pa.Table:
    """Rows that nodes send and keep; ``sketch`` is the member's."""
    n = len(node)
    fill = lambda a, value, kind: np.full(n, value, kind) if a is None else np.asarray(a, kind)
    return pa.table(
        {
            "what": pa.array(np.full(n, what, np.int32)),
            "node": pa.array(np.asarray(node, np.int64)),
            "member": pa.array(np.asarray(member, np.int64)),
            "sim": pa.array(fill(sim, _NOTHING, np.float32)),
            "fresh": pa.array(fill(fresh, False, bool)),
            "kth": pa.array(fill(kth, _NOTHING, np.float32)),
            "sketch": pa.array([b""] * n if sketch is None else sketch, pa.binary()),
        }
    )


def first_offers(nodes: DataFrame, how: Descent) -> DataFrame:
    """Selves of all nodes, and offers from runs of neighbours in each random order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in by_length(batch, "vector"):
                rng = np.random.default_rng([how.seed, unit.shape[1]])
                bits = 1 << np.arange(62, -1, -1, dtype=np.int64)
                codes = [
                    ((unit @ rng.standard_normal((unit.shape[1], 63)) > 0) * bits).sum(axis=1)
                    for _ in range(how.orders)
                ]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(rows),
                        batch.column("kind").take(rows),
                        pa.array(list(np.stack(codes, axis=1)), pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in sketches(unit)], pa.binary()),
                    ],
                    names=["node", "kind", "codes", "sketch"],
                )

    def compare(kind_runs: list[tuple], each: int) -> pa.Table | None:
        if len(kind_runs) < 2:
            return None
        node = np.array([r[0] for r in kind_runs], np.int64)
        sketch = np.array([r[1] for r in kind_runs], object)
        unit = directions(sketch.tolist())
        sim = unit @ unit.T
        np.fill_diagonal(sim, _NOTHING)
        best = np.argsort(-sim, axis=1, kind="stable")[:, : min(each, len(node) - 1)]
        row = np.repeat(np.arange(len(node)), best.shape[1])
        return flow(OFFER, node[row], node[best.ravel()], sim[row, best.ravel()], sketch=sketch[best.ravel()])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(2, how.list_size // 2)
        held: list[tuple] = []
        now = None
        for batch in batches:
            made = []
            columns = (batch.column(c).to_pylist() for c in ("order", "kind", "node", "sketch"))
            for order, kind, node, sketch in zip(*columns, strict=True):
                if (order, kind) != now or len(held) == how.leaf:
                    made.append(compare(held, each))
                    held, now = [], (order, kind)
                held.append((node, sketch))
            tables = [t for t in made if t is not None]
            if tables:
                yield from pa.concat_tables(tables).combine_chunks().to_batches()
        last = compare(held, each)
        if last is not None:
            yield from last.to_batches()

    placed = stored(
        nodes.mapInArrow(lean(place), "node bigint, kind bigint, codes array<bigint>, sketch binary"), "placed"
    )
    keys = ["order", "kind", "code", "node"]
    orders = placed.select("node", "kind", F.posexplode("codes").alias("order", "code"), "sketch")
    offers = orders.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lean(leaves), _FLOW)
    selves = placed.select(
        F.lit(SELF).alias("what"),
        "node",
        F.col("node").alias("member"),
        F.lit(_NOTHING).cast("float").alias("sim"),
        F.lit(False).alias("fresh"),
        F.lit(_NOTHING).cast("float").alias("kth"),
        "sketch",
    )
    return selves.unionByName(offers)


def arrays(group: pa.Table) -> dict[str, np.ndarray]:
    found = {c: group.column(c).to_numpy() for c in ("what", "node", "member", "sim", "fresh", "kth")}
    sketch = np.empty(group.num_rows, object)
    sketch[:] = group.column("sketch").to_pylist()
    return found | {"sketch": sketch}


def kept_lists(group: pa.Table, how: Descent) -> pa.Table:
    """New lists of a bucket's nodes from their lists and what was offered; and who names whom."""
    near = how.threshold - how.margin
    a = arrays(group)
    own = a["what"] == SELF
    rows = np.flatnonzero((a["what"] == ENTRY) | (a["what"] == OFFER))
    # One row a pair: the list's own before an offer.
    rows = rows[np.lexsort((a["what"][rows], a["member"][rows], a["node"][rows]))]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(a["node"][rows]) != 0) | (np.diff(a["member"][rows]) != 0)
    rows = rows[new]
    order, rank = ranks(a["member"][rows], -a["sim"][rows], a["node"][rows])
    rows = rows[order]
    node, sim = a["node"][rows], a["sim"][rows]
    ids, at = np.unique(node, return_inverse=True)
    over = np.bincount(at, sim >= near, len(ids)).astype(np.int64)
    size = np.maximum(how.list_size, np.minimum(how.most_listed, over))
    stays = rank < size[at]
    rows, node, sim, at = rows[stays], node[stays], sim[stays], at[stays]
    count = np.bincount(at, minlength=len(ids))
    last = np.full(len(ids), 2.0, np.float32)
    np.minimum.at(last, at, sim)
    kth = np.where(count >= how.list_size, last, _NOTHING).astype(np.float32)
    fresh = (a["what"][rows] == OFFER) | a["fresh"][rows]
    member, sketch = a["member"][rows], a["sketch"][rows]
    self_of = dict(zip(a["node"][own].tolist(), a["sketch"][own], strict=True))
    named = np.array([self_of[n] for n in node.tolist()] or [b""], object)[: len(node)]
    return pa.concat_tables(
        [
            flow(SELF, a["node"][own], a["node"][own], sketch=a["sketch"][own]),
            flow(ENTRY, node, member, sim, fresh, a["kth"][rows], sketch),
            flow(REVERSE, member, node, sim, fresh, kth[at], named),
        ]
    ).combine_chunks()


def met(group: pa.Table, how: Descent) -> pa.Table:
    """A round at a bucket's nodes: their lists, no longer fresh where looked at, and offers and links."""
    near = how.threshold - how.margin
    a = arrays(group)
    what, all_fresh = a["what"], a["fresh"]
    own, entry, reverse = (np.flatnonzero(what == k) for k in (SELF, ENTRY, REVERSE))
    ids = np.sort(a["node"][own])
    at_entry = np.searchsorted(ids, a["node"][entry])
    count = np.bincount(at_entry, minlength=len(ids))
    last = np.full(len(ids), 2.0, np.float32)
    np.minimum.at(last, at_entry, a["sim"][entry])
    kth_of = np.where(count >= how.list_size, last, _NOTHING).astype(np.float32)
    # The best new and the best old ones of a list are looked at.
    looked = np.zeros(len(what), bool)
    for flag in (True, False):
        part = entry[all_fresh[entry] == flag]
        order, rank = ranks(a["member"][part], -a["sim"][part], a["node"][part])
        looked[part[order[rank < how.list_size]]] = True
    rows = np.concatenate([own, entry[looked[entry]], reverse])
    # One row a pair; a node itself first, then what is new.
    rows = rows[np.lexsort((~all_fresh[rows], what[rows] != SELF, a["member"][rows], a["node"][rows]))]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(a["node"][rows]) != 0) | (np.diff(a["member"][rows]) != 0)
    listed = np.isin(rows, entry)
    pair = np.cumsum(new) - 1
    in_list = np.bincount(pair, listed) > 0
    rows = rows[new]
    order, place = ranks(a["member"][rows], a["node"][rows])
    rows, in_list = rows[order], in_list[order]
    at = np.searchsorted(ids, a["node"][rows])
    width = int(place.max(initial=0)) + 1
    shape = (len(ids), width)
    member = np.full(shape, -1, np.int64)
    member[at, place] = a["member"][rows]
    fresh = np.zeros(shape, bool)
    fresh[at, place] = all_fresh[rows]
    is_self = np.zeros(shape, bool)
    is_self[at, place] = what[rows] == SELF
    list_member = np.zeros(shape, bool)
    list_member[at, place] = in_list
    known = np.full(shape, _NOTHING, np.float32)
    known[at, place] = np.where(what[rows] == SELF, kth_of[at], a["kth"][rows])
    which = np.zeros(shape, np.int64)
    which[at, place] = rows
    vector = directions(a["sketch"][rows].tolist())
    full = np.zeros((*shape, vector.shape[1]), np.float32)
    full[at, place] = vector
    sim = full @ full.transpose(0, 2, 1)
    there = member >= 0
    both = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
    both &= ~np.eye(width, dtype=bool)
    both &= ~(is_self[:, :, None] & list_member[:, None, :] | is_self[:, None, :] & list_member[:, :, None])
    # Where a member's list is not known, the node's own tells what is worth an offer.
    hint = np.maximum(known, kth_of[:, None])[:, :, None]
    offered = both & ((sim > hint) | (sim >= near) & (sim > known[:, :, None]))
    b, i, j = np.nonzero(offered)
    node, other, s = member[b, i], member[b, j], sim[b, i, j]
    order = np.lexsort((other, node))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(node[order]) != 0) | (np.diff(other[order]) != 0)
    order = order[first]
    b, i, j, node, other, s = (x[order] for x in (b, i, j, node, other, s))
    order, rank = ranks(other, -s, node)
    order = order[rank < 2 * how.list_size]
    b, i, j, node, other, s = (x[order] for x in (b, i, j, node, other, s))
    # Partners that neither list has room for.
    spare = both & (sim >= near) & ~offered & ~offered.transpose(0, 2, 1)
    sb, si, sj = np.nonzero(np.triu(spare))
    order, rank = ranks(np.random.default_rng(how.seed).permutation(len(sb)), sb)
    order = order[rank < how.spare_links]
    sb, si, sj = sb[order], si[order], sj[order]
    left = np.concatenate([own, entry])
    kept = pa.table(
        {
            c: group.column(c).take(pa.array(left))
            for c in ("what", "node", "member", "sim", "fresh", "kth", "sketch")
        }
    )
    at_fresh = kept.schema.get_field_index("fresh")
    kept = kept.set_column(at_fresh, "fresh", pa.array((all_fresh & ~looked)[left]))
    return pa.concat_tables(
        [
            kept,
            flow(OFFER, node, other, s, kth=known[b, j], sketch=a["sketch"][which[b, j]]),
            flow(LINK, member[sb, si], member[sb, sj], sim[sb, si, sj], sketch=a["sketch"][which[sb, sj]]),
        ]
    ).combine_chunks()


def bucketed(rows: DataFrame, buckets: int):
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("_bucket")
    return rows.withColumn("_bucket", bucket).groupBy("_bucket", F.octet_length("sketch").alias("_length"))


def thinned(reverse: DataFrame, turn: int, how: Descent) -> DataFrame:
    """At most ``reverse`` rows a node; partial maxima come before the shuffle."""
    pick = F.xxhash64("member", F.lit(turn))
    best = F.max(F.struct("fresh", pick.alias("_pick"), "member", "sim", "kth", "sketch")).alias("_r")
    slots = reverse.groupBy("node", F.pmod(pick, F.lit(how.reverse)).alias("_slot")).agg(best)
    return slots.select(
        F.lit(REVERSE).alias("what"), "node", "_r.member", "_r.sim", "_r.fresh", "_r.kth", "_r.sketch"
    )


def descend(state: DataFrame, buckets: int, turn: int, how: Descent) -> tuple[DataFrame, list[DataFrame], int]:
    """Rounds from offers or lists until hardly any partner is new: lists, spare links, last turn."""
    near = how.threshold - how.margin
    spare: list[DataFrame] = []
    lists = stored(bucketed(state, buckets).applyInArrow(lambda g: kept_lists(g, how), _FLOW), "lists")
    while True:
        turn += 1
        met_by = lists.where(F.col("what") != REVERSE).unionByName(
            thinned(lists.where(F.col("what") == REVERSE), turn, how)
        )
        round_ = stored(bucketed(met_by, buckets).applyInArrow(lambda g: met(g, how), _FLOW), "round")
        spare.append(round_.where(F.col("what") == LINK).select("node", "member"))
        rest = round_.where(F.col("what") != LINK)
        lists = stored(bucketed(rest, buckets).applyInArrow(lambda g: kept_lists(g, how), _FLOW), "lists")
        partners = lists.where((F.col("what") == ENTRY) & (F.col("sim") >= near))
        per_node = partners.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fresh"), 1)).alias("new")
        )
        full = F.col("n") >= how.most_listed
        counts = per_node.agg(F.sum(F.when(full, 0).otherwise(F.col("new"))), F.sum("n")).first()
        if (counts[0] or 0) <= how.ended * (counts[1] or 0):
            return lists, spare, turn


def verified(pairs: DataFrame, nodes: DataFrame, how: Descent) -> DataFrame:
    """Those of the pairs (u, v) whose vectors link, in double precision."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.zeros(batch.num_rows, bool)
            for at, x in by_length(batch, "x"):
                y = units(batch.column("y").take(pa.array(at)))
                links[at] = (x * y).sum(axis=1) >= how.threshold
            yield batch.select(["u", "v"]).filter(pa.array(links))

    vector = nodes.select("node", "vector")
    first = vector.select(F.col("node").alias("u"), F.col("vector").alias("x"))
    second = vector.select(F.col("node").alias("v"), F.col("vector").alias("y"))
    joined = pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y")
    return joined.mapInArrow(lean(check), "u bigint, v bigint")


def audit(nodes: DataFrame, how: Descent) -> DataFrame:
    """All links (u, v) of a fixed number of nodes, found by comparing them with every node."""
    asked = nodes.select("node", "kind", "vector").orderBy(F.xxhash64("node", F.lit(how.seed)), "node")
    sample = asked.limit(how.audited).toArrow()
    by_kind: dict[tuple, tuple[list[int], list[np.ndarray]]] = {}
    for batch in sample.to_batches():
        for at, unit in by_length(batch, "vector"):
            for r, u in zip(at.tolist(), unit, strict=True):
                key = batch.column("kind")[r].as_py(), len(u)
                by_kind.setdefault(key, ([], []))[0].append(batch.column("node")[r].as_py())
                by_kind[key][1].append(u)
    queries = {key: (np.array(ids), np.array(rows)) for key, (ids, rows) in by_kind.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, kind = batch.column("node").to_numpy(), batch.column("kind").to_numpy()
            for at, unit in by_length(batch, "vector"):
                for k in np.unique(kind[at]):
                    ids, rows = queries.get((int(k), unit.shape[1]), (None, None))
                    if ids is None:
                        continue
                    of = np.flatnonzero(kind[at] == k)
                    hit, q = np.nonzero(unit[of] @ rows.T >= how.threshold)
                    u, v = ids[q], node[at][of][hit]
                    other = u != v
                    yield pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other])], names=["u", "v"])

    return nodes.select("node", "kind", "vector").mapInArrow(lean(compare), "u bigint, v bigint")


def near_duplicates(nodes: DataFrame, how: Descent) -> Found:
    """Groups of linked nodes (of :func:`distinct_nodes`)."""
    buckets = max(1, -(-nodes.count() // how.bucket))
    truth = stored(audit(nodes, how), "audited")
    state, spare, turn = first_offers(nodes, how), [], 0
    while True:
        lists, more, turn = descend(state, buckets, turn, how)
        spare += more
        near = (F.col("what") == ENTRY) & (F.col("sim") >= how.threshold - how.margin)
        pairs = lists.where(near).select("node", "member")
        for part in spare:
            pairs = pairs.unionByName(part)
        ends = pairs.select(F.least("node", "member").alias("u"), F.greatest("node", "member").alias("v"))
        edges = stored(verified(ends.distinct(), nodes, how), "links")
        members = stored(components(edges), "members").withColumnRenamed("node", "_node")
        one = members.select(F.col("_node").alias("u"), F.col("component").alias("_one"))
        two = members.select(F.col("_node").alias("v"), F.col("component").alias("_two"))
        judged = truth.join(one, "u", "left").join(two, "v", "left")
        missed = stored(judged.where("NOT coalesce(_one = _two, false)").select("u", "v"), "missed")
        lost, total = missed.count(), truth.count()
        share = 1 - lost / total if total else 1.0
        if share >= how.recall:
            break
        how = replace(
            how,
            list_size=2 * how.list_size,
            most_listed=2 * how.most_listed,
            reverse=2 * how.reverse,
            leaf=2 * how.leaf,
            seed=how.seed + 1,
        )
        state = lists.where(F.col("what").isin(SELF, ENTRY)).withColumn("fresh", F.col("what") == ENTRY)
        state = state.unionByName(first_offers(nodes, how).where(F.col("what") == OFFER))
    if lost:
        edges = stored(edges.unionByName(missed), "links")
        members = stored(components(edges), "members").withColumnRenamed("node", "_node")
    return Found(nodes, edges, members.withColumnRenamed("_node", "node"), share)


def linked_weights(found: Found, how: Descent) -> DataFrame:
    """(node, links): the weight of all other nodes that a node links with, counted in its group."""
    own = found.members.join(found.nodes.select("node", "vector", "weight"), "node")
    sizes = found.members.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    bins = max(1, -(-found.members.count() // how.tile))
    blocks = F.ceil(F.col("_size") / how.tile).cast("bigint")
    # Small groups share a tile; of large ones, each pair of blocks is a tile.
    others = F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)
    placed = own.join(sizes, "component").withColumn("_blocks", blocks)
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    tiles = placed.withColumn("_other", F.explode(others)).select(
        "node",
        "component",
        "vector",
        "weight",
        "_own",
        F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins)))
        .otherwise(F.col("component"))
        .alias("_place"),
        (F.col("_blocks") > 1).alias("_large"),
        F.least("_own", "_other").alias("_low"),
        F.greatest("_own", "_other").alias("_high"),
    )

    def count(group: pa.Table) -> pa.Table:
        component = group.column("component").to_numpy()
        node, weight, side = (group.column(c).to_numpy() for c in ("node", "weight", "_own"))
        first, second = (group.column(c)[0].as_py() for c in ("_low", "_high"))
        vectors = group.column("vector").combine_chunks()
        order = np.argsort(component, kind="stable")
        links = np.zeros(len(node), np.int64)
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            unit = units(vectors.take(pa.array(at)))
            low = side[at] == first
            for a in range(0, len(at), 512):
                part = at[a : a + 512]
                near = unit[a : a + 512] @ unit.T >= how.threshold
                near[np.arange(len(part)), np.arange(a, a + len(part))] = False
                if first != second:  # two blocks: only pairs across them
                    near &= low[a : a + 512, None] != low[None, :]
                links[part] = near @ weight[at]
        return pa.table({"node": node, "links": links})

    counted = tiles.groupBy("_large", "_place", "_low", "_high").applyInArrow(count, "node bigint, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def deduplicate(vectors: DataFrame, how: Descent | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, and the measured recall of the descent."""
    how = how or Descent()
    rows = keyed_vectors(vectors)
    found = near_duplicates(distinct_nodes(rows), how)
    links = stored(linked_weights(found, how), "counted")
    own = found.nodes.select("node", "kind", "_a", "_b", "least", "weight")
    grouped = own.join(found.members, "node", "left").join(links, "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("least").alias("_least"))
    answers = grouped.join(least, "component").select(
        "kind", "_a", "_b", "_least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links")
    )
    # A row that links with nothing is its own group.
    joined = rows.select("vec_id", "kind", "_a", "_b").join(answers, ["kind", "_a", "_b"], "left")
    component = F.when(F.col("kind").isNull(), F.col("vec_id")).otherwise(F.col("_least"))
    return joined.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
        F.lit(found.recall).alias("recall"),
    )
