"""Operator 11: the prefix trie of rebuilt conversations, from ternary search trees of range shards.

Turns are named by the codes of a dictionary of distinct (role, text). A conversation is the
array of its codes. Arrays are sorted over the cluster by range, so that a shard holds
neighbours, and a hot first turn or a large group of equal conversations spreads over as many
shards as its rows fill. A task cuts its sorted rows into shards of bounded size. Each shard is
a ternary search tree, into which the median of its sequences goes first, then those of both
halves; one traversal with a stack of its own adds up members, leaves and savings.

Only nodes on the way to a shard's first and last sequence can go on in its neighbours. Those
boundary nodes, the depth of a sequence times the number of shards at most, are merged in the
order of the shards with one stack. All others are whole at once. Ids that end at a boundary
node are hashed where they meet, in order, a shard's share at a time.

Defined cases: a null role or text is empty; a null turn comes first, and turns of one number
follow by role, then by the hashes of text and role; repeated rows are turns of their own; rows
without a conv_id belong to no conversation; an empty table gives no rows, not even a root; a
text may be of any length, only its code and its length are shuffled; one conversation is held
as a whole, at 16 bytes a turn; other columns are not looked at. c-c%100 and c%6 follow SQL, so
a negative conv_id leans towards zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle

#: Turns that one tree may take in before the next begins; a conversation is never cut.
SHARD_TURNS = 1 << 17
#: Ids that one row of a boundary node's ending conversations holds.
CHUNK = 100_000
GROUP, HEADS = 100, 6
NO_ENDS = sha256(b"").hexdigest()
ROOT = bytes(16)

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: whole nodes below whole ones; 1: whole nodes below a boundary node; 2: parts of boundary nodes; 3: ids that end at them.
PART = f"kind int, {NODE}, node binary, above binary, task int, shard int, later int, chars long, n_ends long, ids binary"
NAMES = [x.split()[0] for x in PART.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
ARROW = pa.schema([(a, TYPES[b]) for a, b in (x.split() for x in PART.split(", "))])


def turn_codes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, turn, role, a, b), two hashes for the text; and the dictionary (a, b, code, chars)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    turns = rows.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"), F.length("text").cast("long").alias("chars"))
    turns = settle(turns)
    words = turns.groupBy("a", "b").agg(F.first("chars").alias("chars"))
    return turns.drop("chars"), settle(words.withColumn("code", F.monotonically_increasing_id()))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, codes and chars of each rebuilt conversation: the head of its group's first one, then its own rest."""
    turns, words = turn_codes(conversations)
    named = turns.join(words, ["a", "b"]).select("conv_id", F.struct("turn", "role", "a", "b", "code", "chars").alias("t"))
    own = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = settle(own.select("conv_id", F.transform("t", lambda x: F.struct(x["code"].alias("code"), x["chars"].alias("chars"))).alias("t")))
    lead = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(lead == F.col("conv_id")).select(F.col("conv_id").alias("lead"), F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    rows = own.withColumn("lead", lead).withColumn("h", h).join(heads, "lead", "left")
    rest = F.when(F.size("t") > F.col("h"), F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(1)))).otherwise(F.slice("t", 1, 0))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("t", 1, 0))
    return rows.select("conv_id", F.concat(head, rest).alias("t")).select("conv_id", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))


class Tree:
    """A ternary search tree of one shard; its numbered nodes are those of the trie, each with its siblings as a search tree."""

    def __init__(self, rows: list[tuple[int, list[int], list[int]]]):
        self.rows = rows
        self.code, self.low, self.high, self.down = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.chars = [-1], [0], [0]
        #: The first and the end of the rows that end at a node.
        self.begin, self.end = [0], [0]
        groups = [0] + [k for k in range(1, len(rows)) if rows[k][1] != rows[k - 1][1]] + [len(rows)]
        halves = [(0, len(groups) - 1)]
        while halves:
            a, b = halves.pop()
            if a < b:
                middle = (a + b) // 2
                self._insert(rows[groups[middle]][1], rows[groups[middle]][2], groups[middle], groups[middle + 1])
                halves += [(a, middle), (middle + 1, b)]
        self._add_up()

    def _new(self, code: int, parent: int, chars: int) -> int:
        for values, value in ((self.code, code), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.begin, 0), (self.end, 0)):
            values.append(value)
        return len(self.code) - 1

    def _insert(self, codes: list[int], chars: list[int], begin: int, end: int) -> None:
        code, low, high, down = self.code, self.low, self.high, self.down
        at = 0
        for wanted, size in zip(codes, chars):
            if down[at] < 0:
                down[at] = self._new(wanted, at, size)
                at = down[at]
                continue
            above, at = at, down[at]
            while code[at] != wanted:
                side = low if wanted < code[at] else high
                if side[at] < 0:
                    side[at] = self._new(wanted, above, size)
                at = side[at]
        self.begin[at], self.end[at] = begin, end

    def _order(self) -> list[int]:
        """Nodes with parents before children and siblings in the order of their codes."""
        order, stack = [0], [(self.down[0], False)]
        while stack:
            node, seen = stack.pop()
            if node < 0:
                continue
            if seen:
                order.append(node)
                stack.append((self.down[node], False))
            else:
                stack += [(self.high[node], False), (node, True), (self.low[node], False)]
        return order

    def _add_up(self) -> None:
        n = len(self.code)
        self.members = [b - a for a, b in zip(self.begin, self.end)]
        self.least = [self.rows[a][0] if b > a else None for a, b in zip(self.begin, self.end)]
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        for node in reversed(self._order()):
            if not self.children[node]:
                self.leaves[node] = 1
            self.saved[node] += (self.members[node] - 1) * self.chars[node]
            above = self.parent[node]
            if above >= 0:
                self.members[above] += self.members[node]
                self.children[above] += 1
                self.leaves[above] += self.leaves[node]
                self.saved[above] += self.saved[node]
                if self.least[above] is None or self.least[node] < self.least[above]:
                    self.least[above] = self.least[node]

    def path(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence of this tree, the root first."""
        found = [0]
        for wanted in codes:
            at = self.down[found[-1]]
            while self.code[at] != wanted:
                at = self.low[at] if wanted < self.code[at] else self.high[at]
            found.append(at)
        return found

    def ids(self, begin: int, end: int) -> bytes:
        return ",".join(str(x[0]) for x in self.rows[begin:end]).encode()


def _common(one: list[int], other: list[int]) -> int:
    size = 0
    for a, b in zip(one, other):
        if a != b:
            break
        size += 1
    return size


def _below(node: bytes, code: int) -> bytes:
    return blake2b(node + code.to_bytes(8, "little", signed=True), digest_size=16).digest()


def _shard(rows: list[tuple[int, list[int], list[int]]], before: list[int] | None, after: list[int] | None, task: int, shard: int, chunk: int = CHUNK) -> Iterator[dict]:
    """Whole nodes and boundary parts of one shard. before, after: the neighbours' sequences, None where another task has them."""
    tree = Tree(rows)
    first, last = tree.path(rows[0][1]), tree.path(rows[-1][1])
    first = first if before is None else first[: _common(before, rows[0][1]) + 1]
    last = last if after is None else last[: _common(rows[-1][1], after) + 1]
    key: dict[int, bytes] = {0: ROOT}
    later: dict[int, int] = {}
    for flag, path in enumerate((first, last)):
        for node in path:
            if node not in later:
                later[node] = flag
                if node:
                    key[node] = _below(key[tree.parent[node]], tree.code[node])
    own = {node: [0, 0, 0] for node in later}
    for node in range(1, len(tree.code)):
        above = tree.parent[node]
        if node not in later and above in later:
            part = own[above]
            part[0], part[1], part[2] = part[0] + 1, part[1] + tree.leaves[node], part[2] + tree.saved[node]
    for node in range(len(tree.code)):
        above, begin, end = tree.parent[node], tree.begin[node], tree.end[node]
        row = {"conv_id": tree.least[node], "depth": tree.depth[node], "n_convs": tree.members[node], "task": task, "shard": shard, "chars": tree.chars[node]}
        if node in later:
            # Members below boundary children are counted there as parts of the same path, so a part has all of this shard's.
            inner, leaves, saved = own[node]
            yield row | {"kind": 2, "node": key[node], "above": key[above] if above >= 0 else None, "later": later[node], "n_children": inner, "n_leaves": leaves, "saved_tokens": saved, "n_ends": end - begin}
            for k in range(begin, end, chunk):
                yield {"kind": 3, "node": key[node], "task": task, "shard": shard, "later": k, "ids": tree.ids(k, min(k + chunk, end))}
        else:
            ends = sha256(tree.ids(begin, end)).hexdigest() if end > begin else NO_ENDS
            row |= {"n_children": tree.children[node], "n_leaves": tree.leaves[node], "saved_tokens": tree.saved[node], "ends_sha256": ends}
            yield row | ({"kind": 1, "above": key[above]} if above in later else {"kind": 0, "parent_conv_id": tree.least[above]})


def _batches(rows: Iterator[dict], schema: pa.Schema = ARROW, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _shards(rows: Iterator[tuple[int, list[int], list[int]]], task: int, shard_turns: int, chunk: int) -> Iterator[dict]:
    """What the shards of one task's sorted rows yield."""
    held: list[tuple[int, list[int], list[int]]] = []
    size, shard, before = 0, 0, None
    for row in rows:
        if size >= shard_turns or len(held) >= shard_turns:
            yield from _shard(held, before, row[1], task, shard, chunk)
            held, size, shard, before = [], 0, shard + 1, held[-1][1]
        held.append(row)
        size += len(row[1])
    if held:
        yield from _shard(held, before, None, task, shard, chunk)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes from their parts in the order of the shards; the open path is all that is held."""

    def rows() -> Iterator[dict]:
        stack: list[dict] = []

        def close() -> dict:
            node = stack.pop()
            node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("chars")
            if not node["n_children"]:
                node["n_leaves"] = 1
            if stack:
                above = stack[-1]
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
            return node

        for batch in batches:
            for part in batch.to_pylist():
                depth = part["depth"]
                if depth < len(stack) and stack[depth]["node"] == part["node"]:
                    node = stack[depth]
                    node["conv_id"] = min(node["conv_id"], part["conv_id"])
                    for name in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"):
                        node[name] += part[name]
                else:
                    while len(stack) > depth:
                        yield close()
                    stack.append(part)
        while stack:
            yield close()

    return _batches(rows(), pa.schema([(x, ARROW.field(x).type) for x in BOUNDARY]))


BOUNDARY = ["node", "above", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its ids, which come chunk by chunk in order."""

    def rows() -> Iterator[dict]:
        node, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["node"] != node:
                    if node is not None:
                        yield {"node": node, "ends_sha256": digest.hexdigest()}
                    node, digest = row["node"], sha256(row["ids"])
                else:
                    digest.update(b"," + row["ids"])
        if node is not None:
            yield {"node": node, "ends_sha256": digest.hexdigest()}

    return _batches(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
        return _batches(_shards(rows, TaskContext.get().partitionId(), shard_turns, chunk))

    rows = settle(rebuilt(conversations))
    rows = rows.select("conv_id", "codes", "chars").repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    parts = settle(rows.mapInArrow(run, PART), "kind")
    edge = parts.where("kind = 2").select("task", "shard", "later", "chars", *BOUNDARY)
    edge = edge.repartition(1).sortWithinPartitions("task", "shard", "later", "depth")
    merged = settle(edge.mapInArrow(_merged, "node binary, above binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long"))
    ends = parts.where("kind = 3").select("node", "task", "shard", "later", "ids").repartition("node").sortWithinPartitions("node", "task", "shard", "later")
    ends = ends.mapInArrow(_hashed, "node binary, ends_sha256 string")
    boundary = merged.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    names = [x.split()[0] for x in NODE.split(", ")]
    above = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    open_ = parts.where("kind = 1").drop("parent_conv_id").select("above", *[x for x in names if x != "parent_conv_id"])
    open_ = open_.unionByName(boundary.select("above", *[x for x in names if x != "parent_conv_id"])).join(above, "above", "left")
    return parts.where("kind = 0").select(*names).unionByName(open_.select(*names))
