"""The prefix trie of conversations, with subtree totals by time-forward processing.

A conversation is its sequence of turns; a node of the trie is a distinct prefix
(a depth and two 64-bit XORs of hashes of its turns, each hashed with its place),
its members are the conversations that start with it.  Members, bytes and ends of
a node are plain aggregations over the (conversation, place) rows, whose places
and prefix hashes come from one range-sorted scan each: a conversation that is
cut by a partition's edge takes its state on from the partitions before.

Totals over subtrees (leaves, saved bytes) go from children to parents in time-
forward manner.  The nodes are range-sorted so that subtrees lie together, and
the ranges are the *shards*.  A shard reads its nodes in reverse level order;
each node takes what its children sent from a priority queue, adds its own and
sends the sum to its parent through the queue, which spills sorted runs.  What
is sent to nodes outside is summed per receiver: these are the shard's roots.
They form a much smaller tree (a shard has no more of them than there are nodes
above it that have children in it), which is run through the same queue; then the
shards are run again with what reaches them from other shards.

``SPILL_ROWS`` bounds the queue's memory.  Its runs are unnamed files of the task
that wrote them, like Spark's own spills: no other task reads them.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lookup, pick, stored

SPILL_ROWS = 200_000
IDS_PER_BLOCK = 4096  # conversation ids digested as one text
OUT_ROWS = 8192


class SpillingQueue:
    """A priority queue of equally long tuples of integers.  Beyond ``limit`` items the
    queue's content is written as a sorted run; pops merge the runs with what is in memory."""

    def __init__(self, limit: int = SPILL_ROWS):
        self.limit, self.heap, self.heads, self.spills = limit, [], [], 0

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill(sorted(self.heap))
            self.heap = []
            if len(self.heads) > 64:  # many runs become one
                merged, self.heads = heapq.merge(*[self._rest(h) for h in self.heads]), []
                self._spill(merged)

    @staticmethod
    def _rest(head: tuple) -> Iterator[tuple[int, ...]]:
        yield head[0]
        yield from head[2]

    def _spill(self, items) -> None:
        file, width, part = tempfile.TemporaryFile(), 0, []
        for item in items:
            width = len(item)
            part.append(item)
            if len(part) == OUT_ROWS:
                file.write(np.array(part, np.int64).tobytes())
                part = []
        file.write(np.array(part, np.int64).tobytes())
        self.spills += 1

        def read() -> Iterator[tuple[int, ...]]:
            file.seek(0)
            while data := file.read(OUT_ROWS * width * 8):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, width).tolist())
            file.close()

        run = read()
        heapq.heappush(self.heads, (next(run), self.spills, run))

    def peek(self) -> tuple[int, ...] | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if not self.heads or (self.heap and self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, number, run = self.heads[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, number, run))
        return item

    def take(self, key: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Pop all items that start with ``key``."""
        out, size = [], len(key)
        while (top := self.peek()) is not None and top[:size] == key:
            out.append(self.pop())
        return out


def _rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                      [pa.array([], f.type) for f in schema], schema=schema)


def _longs(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)


# -- the scans -------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``: the place (from 1) of each in its conversation, by ``order``.

    Rows are sorted by range and counted as they stream by; the count of a
    conversation that began in earlier partitions is added from a table of one row per partition."""
    fields = [f for f in rows.schema if f.name != "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        for b in batches:
            conv = b.column("conv_id").to_numpy()
            new = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv)))) + 1
            if len(conv) and conv[0] == now:
                at[:new[1] if len(new) > 1 else len(conv)] += count
            if len(conv):
                now, count = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "at"])

    parted = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("piece", F.spark_partition_id())
    columns = ["conv_id", *[f.name for f in fields], "piece"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parted.select(*columns).schema)
    parted = stored(parted.select(*columns).mapInArrow(run, f"{schema}, at long"), name)
    return _carried(parted, {"at": ("count", "sum")})


def _carried(parted: DataFrame, state: dict[str, tuple[str, str]]) -> DataFrame:
    """Carry the state of conversations over partition edges.  ``state``: column -> (how
    a partition's rows make its total, how totals and rows are put together)."""
    made = {"count": lambda c: F.count("*"), "xor": F.bit_xor, "or": F.bit_or}
    added = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, Column.bitwiseXOR), "or": (F.bit_or, Column.bitwiseOR)}
    # Only a partition's first and last conversations can go on in another one: two rows per partition.
    edges = parted.groupBy("piece").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    totals = (parted.join(F.broadcast(edges), "piece").where("conv_id in (low, high)")
              .groupBy("piece", "conv_id").agg(*[made[how](f"own_{c}" if how == "xor" else c).alias(c) for c, (how, _) in state.items()]))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("piece", "conv_id", *[added[join][0](c).over(before).alias(f"c_{c}") for c, (_, join) in state.items()])
    carry = carry.where(" or ".join(f"c_{c} is not null" for c in state))
    out = parted.join(F.broadcast(carry), ["piece", "conv_id"], "left")
    for c, (_, join) in state.items():
        out = out.withColumn(c, F.when(F.col(f"c_{c}").isNull(), F.col(c)).otherwise(added[join][1](F.col(c), F.col(f"c_{c}"))))
    return out.drop("piece", *[f"c_{c}" for c in state], *[f"own_{c}" for c, (how, _) in state.items() if how == "xor"])


def _prefixes(rows: DataFrame, name: str) -> DataFrame:
    """Prefix hashes of (conv_id, depth, digest, n_bytes, last) rows: x1, x2 of the prefix
    that ends here, p1, p2 of the one before, and ``place``, the order in which nodes are laid out."""
    schema = "conv_id long, depth long, n_bytes long, last boolean, piece int, own_x1 long, own_x2 long, x1 long, x2 long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, (np.uint64(0), np.uint64(0), np.uint64(0))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv, depth = b.column("conv_id").to_numpy(), b.column("depth").to_numpy()
            words = np.frombuffer(b"".join(x.as_py() for x in b.column("digest")), "<u8").reshape(n, 2)
            salt = _mixed(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = [_mixed(words[:, 0] ^ salt), _mixed(words[:, 1] + salt)]
            new = np.concatenate(([True], conv[1:] != conv[:-1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            upto = []
            for k, e in enumerate(own):
                x = np.bitwise_xor.accumulate(e)
                x = x ^ np.where(first > 0, x[first - 1], np.uint64(0))[group]
                if conv[0] == now:
                    x[group == 0] ^= held[k]
                upto.append(x)
            # 21 bits of the hashes of the first three turns: where nodes lie, not what they are.
            part = np.where(depth <= 3, (own[0] >> np.uint64(43)) << (np.uint64(21) * (3 - np.minimum(depth, 3)).astype(np.uint64)), np.uint64(0))
            place = np.bitwise_or.accumulate(part) if len(first) == 1 else np.concatenate([np.bitwise_or.accumulate(p) for p in np.split(part, first[1:])])
            if conv[0] == now:
                place[group == 0] |= held[2]
            now, held = conv[-1], (upto[0][-1], upto[1][-1], place[-1])
            signed = lambda a: pa.array(a.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), b.column("n_bytes"), b.column("last"), b.column("piece"), signed(own[0]),
                                              signed(own[1]), signed(upto[0]), signed(upto[1]), signed(place)], names=[c.split()[0] for c in schema.split(", ")])

    parted = rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("piece", F.spark_partition_id())
    parted = stored(parted.select("conv_id", "depth", "digest", "n_bytes", "last", "piece").mapInArrow(run, schema), name)
    parted = parted.withColumns({"p1": F.col("own_x1"), "p2": F.col("own_x2")})
    out = _carried(parted, {"x1": ("xor", "xor"), "x2": ("xor", "xor"), "place": ("or", "or")})
    return out.withColumns({"p1": F.col("x1").bitwiseXOR(F.col("p1")), "p2": F.col("x2").bitwiseXOR(F.col("p2"))})


# -- digests of the members that end at a node -----------------------------------------------------------------

def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of (depth, x1, x2, conv_id): the SHA-256 of the ids in
    ascending order, joined by commas.  Ids are sorted by range and joined to blocks of
    text by many tasks; a node's blocks then stream through one hash, whose state has a fixed size."""
    key = ["depth", "x1", "x2"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        now, ids, out = None, [], []
        for b in batches:
            for *k, conv in zip(*(c.to_pylist() for c in b.columns)):
                if k != now or len(ids) == IDS_PER_BLOCK:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = k, []
                    if len(out) == 256:
                        yield _rows_out(out, schema)
                        out = []
                ids.append(conv)
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        yield _rows_out(out, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
        now, state, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                    if len(out) == OUT_ROWS:
                        yield _rows_out(out, schema)
                        out = []
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            out.append((*now, state.hexdigest()))
        yield _rows_out(out, schema)

    ends = ends.select(*key, "conv_id")
    blocks = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pack, "depth long, x1 long, x2 long, first long, ids string")
    blocks = blocks.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids")
    return blocks.mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


# -- time-forward processing -----------------------------------------------------------------------------------

NONE = -(1 << 63)  # stands for no parent


def _by_shard(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Run ``work`` over the rows (shard, depth, conv_id, kind, ...) of each shard, in reverse level order."""
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id", "kind")
    return dealt.mapInArrow(work, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(shard, its rows) for rows that come sorted by shard; a shard's rows must be read before the next shard."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = next(rows, None)
    while ahead is not None:
        shard = ahead[0]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == shard:
                row, ahead = ahead, next(rows, None)
                yield row[1:]
        yield shard, own()


def _sums(batches: Iterator[pa.RecordBatch], outside: bool, limit: int) -> Iterator[tuple]:
    """Time-forward sums of rows (shard, depth, conv_id, kind, parent, leaves, saved,
    children): kind 0 is a message from another shard, kind 1 a node.  Yields per node (depth,
    conv_id, leaves, saved, children), or, if ``outside``, per node outside of the shard that it sends to (shard, depth, ...)."""
    for shard, rows in _shards(batches):
        queue = SpillingQueue(limit)

        def leaving(key: tuple[int, int] | None) -> Iterator[tuple]:
            """Messages to nodes that are due before ``key``: they are not in this shard."""
            while (top := queue.peek()) is not None and (key is None or top[:2] < key):
                got = queue.take(top[:2])
                if outside:
                    yield shard, -top[0], top[1], *(sum(g[i] for g in got) for i in (2, 3, 4))

        for depth, conv, kind, parent, leaves, saved, children in rows:
            key = (-depth, conv)
            yield from leaving(key)
            if kind == 0:
                queue.push((*key, leaves, saved, children))
                continue
            for got in queue.take(key):
                leaves, saved, children = leaves + got[2], saved + got[3], children + got[4]
            if parent != NONE:
                queue.push((1 - depth, parent, leaves, saved, 1))
            if not outside:
                yield depth, conv, leaves, saved, children
        yield from leaving(None)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == OUT_ROWS:
            yield _rows_out(part, schema)
            part = []
    yield _rows_out(part, schema)


def _exits(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """For rows of kind 0 (nodes that other shards send to): (shard, depth, conv_id,
    exit_depth, exit_conv), the node outside to which the root above it in its shard sends; NONE at the trie's root.

    Marks go up to the shard's roots; marks that meet are one from there on."""
    for shard, rows in _shards(batches):
        queue, marks, parent_of, out = SpillingQueue(limit), [], [], {}

        def find(i: int) -> int:
            while parent_of[i] != i:
                parent_of[i] = parent_of[parent_of[i]]
                i = parent_of[i]
            return i

        def leaving(key: tuple[int, int] | None) -> None:
            while (top := queue.peek()) is not None and (key is None or top[:2] < key):
                for got in queue.take(top[:2]):
                    out[find(got[2])] = (-top[0], top[1])

        for depth, conv, kind, parent in rows:
            key = (-depth, conv)
            leaving(key)
            if kind == 0:
                marks.append((depth, conv))
                parent_of.append(len(parent_of))
                queue.push((*key, len(parent_of) - 1))
                continue
            got = [find(g[2]) for g in queue.take(key)]
            for g in got[1:]:
                parent_of[find(g)] = find(got[0])
            if got and parent != NONE:
                queue.push((1 - depth, parent, find(got[0])))
        leaving(None)
        for i, mark in enumerate(marks):
            yield shard, *mark, *out.get(find(i), (NONE, NONE))


def _across(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """Time-forward sums over shard roots: rows (depth, shard, conv_id, leaves, saved,
    children, home, exit_depth, exit_conv) in reverse level order; each sends its sum to (home, exit)."""
    queue = SpillingQueue(limit)
    for b in batches:
        for depth, shard, conv, leaves, saved, children, home, exit_depth, exit_conv in zip(*(c.to_pylist() for c in b.columns)):
            for got in queue.take((-depth, shard, conv)):
                leaves, saved = leaves + got[3], saved + got[4]
            if exit_depth != NONE:
                queue.push((-exit_depth, home, exit_conv, leaves, saved))
            yield home, depth, conv, leaves, saved, children


def subtree_sums(nodes: DataFrame, limit: int = SPILL_ROWS) -> DataFrame:
    """(depth, conv_id, leaves, saved, children) of ``nodes``: (shard, depth, conv_id,
    parent, leaf, own), a node being named by depth and conv_id, its parent by depth - 1 and
    ``parent`` (NONE at the root).  ``leaves`` and ``saved`` sum ``leaf`` and ``own`` over the subtree."""
    base = nodes.select("shard", "depth", "conv_id", F.lit(1).cast("long").alias("kind"), "parent", F.col("leaf").alias("leaves"),
                        F.col("own").alias("saved"), F.lit(0).cast("long").alias("children"))
    arrow, schema = _longs("shard", "depth", "conv_id", "leaves", "saved", "children")
    sent = stored(_by_shard(base, lambda b: _in_batches(_sums(b, True, limit), arrow), schema), "trie-sent")
    extra = base.limit(0)
    if sent.limit(1).count():
        receivers = stored(sent.select("depth", "conv_id").distinct(), "trie-receivers")
        homes = stored(lookup(nodes.select("shard", "depth", "conv_id"), receivers, ["depth", "conv_id"], "inner"), "trie-homes")
        marks = homes.select("shard", "depth", "conv_id", F.lit(0).cast("long").alias("kind"), F.lit(NONE).alias("parent"))
        active = lookup(base, stored(homes.select("shard").distinct(), "trie-active"), ["shard"], "inner")
        arrow_e, schema_e = _longs("shard", "depth", "conv_id", "exit_depth", "exit_conv")
        exits = _by_shard(marks.unionByName(active.select("shard", "depth", "conv_id", "kind", "parent")), lambda b: _in_batches(_exits(b, limit), arrow_e), schema_e)
        exits = stored(exits.withColumnRenamed("shard", "home"), "trie-exits")
        roots = lookup(sent, exits, ["depth", "conv_id"], "inner").select("depth", "shard", "conv_id", "leaves", "saved", "children", "home", "exit_depth", "exit_conv")
        # One row per shard and node above it: a stream that one task reads in bounded memory.
        roots = roots.repartition(1).sortWithinPartitions(F.desc("depth"), "shard", "conv_id")
        arrow_a, schema_a = _longs("home", "depth", "conv_id", "leaves", "saved", "children")
        got = stored(roots.mapInArrow(lambda b: _in_batches(_across(b, limit), arrow_a), schema_a), "trie-across")
        got = got.groupBy("home", "depth", "conv_id").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
        extra = got.select(F.col("home").alias("shard"), "depth", "conv_id", F.lit(0).cast("long").alias("kind"), F.lit(NONE).alias("parent"), "leaves", "saved", "children")
    arrow_n, schema_n = _longs("depth", "conv_id", "leaves", "saved", "children")
    return _by_shard(base.unionByName(extra), lambda b: _in_batches(_sums(b, False, limit), arrow_n), schema_n)


# -- the operator ----------------------------------------------------------------------------------------------

def turns_of(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, digest, n_bytes) per turn of a table of conversations: its place
    (from 1) by turn, null first, turns of equal number by the digest of role and text.
    Rows without a conv_id belong to no conversation."""
    t = pick(table, id_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role.cast("binary")).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = t.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"), F.col("turn").cast("long").alias("turn"),
                    F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("digest"), F.octet_length(text.cast("binary")).cast("long").alias("n_bytes"))
    return _placed(rows, ["has_turn", "turn", "digest"], "trie-turns").select("conv_id", "at", "digest", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their group's opening: c takes the first h turns of
    conversation c - c % ``group`` and then its own after its first h, h = crc32(c) % ``heads``.

    Returns (conv_id, depth, digest, n_bytes, last) per turn and (conv_id, length) per conversation."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = stored(convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads,
                                      "base": F.col("conv_id") - F.col("conv_id") % group}), "trie-convs")
    opening = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = lookup(convs, opening, ["base"]).select("conv_id", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs, "trie-lengths")
    own = lookup(turns, convs, ["conv_id"], "inner").where("at > h").withColumn("depth", F.expr("at - h + k"))
    # At most heads - 1 turns of a base conversation, each to at most 2 * group - 1 conversations.
    head = turns.where((F.col("conv_id") % group == 0) & (F.col("at") < heads)).withColumn("base", F.col("conv_id"))
    head = head.withColumn("conv_id", F.explode(F.sequence(F.col("base") - group + 1, F.col("base") + group - 1)))
    head = head.where(F.col("conv_id") - F.col("conv_id") % group == F.col("base"))
    head = lookup(head, convs, ["conv_id"], "inner").where("at <= h").withColumn("depth", F.col("at"))
    rows = [d.select("conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("length")).alias("last")) for d in (own, head)]
    return rows[0].unionByName(rows[1]), convs.select("conv_id", "length")


def trie(rows: DataFrame, convs: DataFrame, limit: int = SPILL_ROWS) -> DataFrame:
    """The nodes of the prefix trie of ``rows`` (conv_id, depth, digest, n_bytes, last)
    and ``convs`` (conv_id, length; also those without turns): conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Without conversations there is no node."""
    key = ["depth", "x1", "x2"]
    prefixes = _prefixes(rows, "trie-prefixes")
    zero = F.lit(0).cast("long")
    ends = prefixes.where("last").select(*key, "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    nodes = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
                                       F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("place").alias("place"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in key], "conv_id", "n_convs", "n_ends", *[zero.alias(c) for c in ("n_bytes", "p1", "p2", "place")])
    nodes = stored(nodes.unionByName(root), "trie-nodes")
    nodes = nodes.join(_end_digests(ends), key, "left")

    # The parent of a first turn is the root, whatever its number of children; other parents are looked up.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    low = nodes.where("depth = 0").select("conv_id").first()
    shallow = nodes.where("depth < 2").withColumn("parent", F.when(F.col("depth") == 1, F.lit(low[0] if low else None).cast("long")))
    deep = nodes.where("depth >= 2").join(parents.where("depth >= 2"), ["depth", "p1", "p2"], "left")
    whole = shallow.unionByName(deep).select(
        "place", "depth", "conv_id", F.coalesce("parent", F.lit(NONE)).alias("parent"), "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    whole = stored(whole.repartitionByRange("place", "conv_id", "depth").withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")
    sums = subtree_sums(whole, limit)
    found = whole.select("depth", "conv_id", "parent", "n_convs", "ends_sha256").join(sums, ["depth", "conv_id"])
    return found.select("conv_id", "depth", F.when(F.col("parent") != NONE, F.col("parent")).alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
