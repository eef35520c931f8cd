"""Trie of conversations that share their first turns.

Turns are numbered by a dictionary, so a conversation is a sequence of longs. Sequences are range-partitioned and sorted;
each run of about SHARD_TURNS turns is a range shard with a ternary search tree of its own, into which the shard's distinct
sequences are inserted median first, so that the search among sibling turns is balanced. One iterative walk adds up members,
leaves and savings. Nodes on a shard's first and last path may go on in the neighbouring shards; these boundary nodes are
merged in range order, within a task as it goes along and then over the tasks, of which only the outer paths are left.

What a task holds at once is one shard and one path. A node whose parent is a boundary node takes the parent's name from a
table of links, keyed by the task and the number of the open node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch, table

FAMILY, FORKS = 5, 9  # conversations of a family share the first turns of its first one, fewer than FORKS of them
SHARD_TURNS = 50_000
TASK_TURNS = 2_000_000
ORDERED = 64  # turns by which ranges are cut; sequences that agree on them stay together
_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE, _LINK, _EDGE = 0, 1, 2
ROWS = pa.schema([(name, pa.int64()) for name in ("kind", "task", "ref", "place", "turn", "conv_id", "depth", "parent_conv_id", "parent_ref", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes")] + [("ends_sha256", pa.string())])
_SPARK_ROWS = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in ROWS)


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, id, bytes: every turn with its dictionary number, the same for equal (role, text).

    Numbers follow the order of the turns' SHA-256, so they do not depend on how the table is split.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(spelled, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = scratch.put(turns, "turns")
    entries = scratch.put(turns.groupBy("digest").agg(F.first("bytes").alias("bytes")), "entries")
    dictionary = scratch.put(entries.repartitionByRange("digest").sortWithinPartitions("digest").withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return turns.drop("bytes").join(dictionary, "digest").select("conv_id", "turn", "id", "bytes")


def fork(conv_id: Column) -> Column:
    """How many turns of its family's first conversation a conversation starts with, at most."""
    return F.crc32(conv_id.cast("string")) % FORKS


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the turns of every rebuilt conversation in order; arrays may be empty.

    Turns go by ``turn`` (null first), those that share one by their digest. A whole family meets in one exchange.
    """
    home = F.col("conv_id") - F.col("conv_id") % FAMILY
    family = turns.withColumn("home", home).repartition("home")
    whole = family.groupBy("home", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "bytes"))).alias("said"))
    first = whole.where("conv_id = home").select("home", F.slice("said", 1, FORKS - 1).alias("shared"))
    h = fork(F.col("conv_id")).cast("int")
    lead = F.when(F.col("shared").isNull(), F.array().cast(whole.schema["said"].dataType)).otherwise(F.slice("shared", F.lit(1), h))
    rest = F.slice("said", h + 1, F.greatest(F.size("said") - h, F.lit(0)))
    joined = whole.join(first, "home", "left").select("conv_id", F.concat(lead, rest).alias("said"))
    return joined.select("conv_id", F.transform("said", lambda x: x["id"]).alias("ids"), F.transform("said", lambda x: x["bytes"]).alias("sizes"))


class _Open:
    """A node that may still grow: what its closed part holds."""

    __slots__ = ("ref", "turn", "bytes", "least", "members", "children", "leaves", "saved", "ends", "aliases")

    def __init__(self, ref, turn, size, least, members, children, leaves, saved, ends):
        self.ref, self.turn, self.bytes, self.least, self.members = ref, turn, size, least, members
        self.children, self.leaves, self.saved, self.ends, self.aliases = children, leaves, saved, ends, []

    def take(self, other: _Open) -> None:
        """Another part of the same node."""
        self.least, self.members = min(self.least, other.least), self.members + other.members
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.ends = other.ends or self.ends


class Tree:
    """Ternary search tree of one shard's distinct sequences, given in order as (ids, sizes, members, least, ends)."""

    def __init__(self, sequences: list[tuple]):
        self.low, self.high, self.down = [-1], [-1], [-1]  # node 0 is the root; the others are turns
        self.turn, self.bytes, self.ends = [0], [0], [None]
        self.members, self.least = [0], [None]
        self.first, self.last = [0], [0]
        spans = [(0, len(sequences))]
        while spans:
            start, end = spans.pop()
            if start < end:
                middle = (start + end) // 2
                path = self._insert(*sequences[middle])
                if middle == 0:
                    self.first = path
                if middle == len(sequences) - 1:
                    self.last = path
                spans += [(middle + 1, end), (start, middle)]

    def _node(self, turn: int, size: int) -> int:
        for column, value in ((self.low, -1), (self.high, -1), (self.down, -1), (self.turn, turn), (self.bytes, size), (self.ends, None), (self.members, 0), (self.least, None)):
            column.append(value)
        return len(self.turn) - 1

    def _insert(self, ids, sizes, members, least, ends) -> list[int]:
        at, path = 0, [0]
        for turn, size in zip(ids, sizes):
            side, owner = self.down, at
            child = self.down[at]
            while child >= 0 and self.turn[child] != turn:
                side, owner = (self.low if turn < self.turn[child] else self.high), child
                child = side[owner]
            if child < 0:
                child = side[owner] = self._node(turn, size)
            at = child
            path.append(at)
        for node in path:
            self.members[node] += members
            if self.least[node] is None or least < self.least[node]:
                self.least[node] = least
        self.ends[at] = ends
        return path

    def children(self, node: int) -> Iterator[int]:
        waiting = [self.down[node]]
        while waiting:
            child = waiting.pop()
            if child >= 0:
                yield child
                waiting += [self.low[child], self.high[child]]

    def sums(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """parent, children, leaves and savings per node; boundary nodes are not added to their parents."""
        size = len(self.turn)
        parent, order = [-1] * size, [0]
        for node in order:  # grows while it is walked: parents come before their children
            for child in self.children(node):
                parent[child] = node
                order.append(child)
        edge = set(self.first) | set(self.last)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for node in reversed(order):
            if node not in edge:
                leaves[node] = leaves[node] or 1
                saved[node] += (self.members[node] - 1) * self.bytes[node]
                children[parent[node]] += 1
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
        return parent, children, leaves, saved


class Seam:
    """Merges shards that arrive in order. Nodes that no later shard can reach are closed and given out.

    With ``outer`` the first path is kept too, as earlier shards of other tasks may share it.
    """

    def __init__(self, task: int, outer: bool):
        self.task, self.outer, self.refs = task, outer, 0
        self.path: list[_Open] = []
        self.left: list[_Open] | None = None  # the first path, root first
        self.out: list[dict] = []

    def _row(self, **values) -> None:
        self.out.append({"task": self.task, **values})

    def _push(self, node: _Open) -> None:
        node.ref, self.refs = self.refs, self.refs + 1
        self.path.append(node)

    def _close(self) -> None:
        node, depth = self.path.pop(), len(self.path)
        if self.outer and depth < len(self.left) and self.left[depth] is node:
            return  # a node of the first path stays open for the tasks before
        leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.bytes
        parent = self.path[-1] if self.path else None
        self._row(kind=_NODE, conv_id=node.least, depth=depth, parent_ref=parent.ref if parent else None, n_convs=node.members,
                  n_children=node.children, n_leaves=leaves, saved_tokens=saved, ends_sha256=node.ends or _NOTHING)
        for task, ref in [(self.task, node.ref), *node.aliases]:
            self.out.append({"kind": _LINK, "task": task, "ref": ref, "conv_id": node.least})
        if parent:
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved

    def feed(self, first: list[_Open], last: list[_Open], shared: int) -> list[_Open]:
        """A shard's first path and the rest of its last path, which leaves the first one after ``shared`` nodes. Gives the
        open nodes with their numbers, in the order of the paths."""
        common = 0
        while common < min(len(self.path), len(first)) and self.path[common].turn == first[common].turn:
            common += 1
        while len(self.path) > common:
            self._close()
        for mine, node in zip(self.path, first):
            mine.take(node)
            mine.aliases += node.aliases
        for node in first[common:]:
            self._push(node)
        opened = list(self.path)
        if self.left is None:
            self.left = opened
        while len(self.path) > shared:
            self._close()
        for node in last:
            self._push(node)
        return opened + last

    def end(self) -> None:
        """Everything left is closed, or named as boundary nodes: place 0 on the first path, 1 on the last."""
        if not self.outer:
            while self.path:
                self._close()
            return
        left = self.left or []
        for place, nodes in ((0, left), (1, self.path)):
            for depth, node in enumerate(nodes):
                if place == 0 or not (depth < len(left) and left[depth] is node):
                    self._row(kind=_EDGE, place=place, ref=node.ref, turn=node.turn, depth=depth, conv_id=node.least, n_convs=node.members,
                              n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, bytes=node.bytes, ends_sha256=node.ends)

    def given(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_pylist(rows, schema=ROWS)


def _add_shard(seam: Seam, sequences: list[tuple]) -> None:
    tree = Tree(sequences)
    parent, children, leaves, saved = tree.sums()
    shared = next((i for i, (a, b) in enumerate(zip(tree.first, tree.last)) if a != b), min(len(tree.first), len(tree.last)))
    path = tree.first + tree.last[shared:]
    opened = [_Open(None, tree.turn[x], tree.bytes[x], tree.least[x], tree.members[x], children[x], leaves[x], saved[x], tree.ends[x]) for x in path]
    n = len(tree.first)
    refs = {x: node.ref for x, node in zip(path, seam.feed(opened[:n], opened[n:], shared))}
    depth = [0] * len(tree.turn)
    waiting = [0]
    while waiting:
        x = waiting.pop()
        for child in tree.children(x):
            depth[child] = depth[x] + 1
            waiting.append(child)
        if x not in refs:
            up = parent[x]
            seam._row(kind=_NODE, conv_id=tree.least[x], depth=depth[x], parent_conv_id=None if up in refs else tree.least[up], parent_ref=refs.get(up),
                      n_convs=tree.members[x], n_children=children[x], n_leaves=leaves[x], saved_tokens=saved[x], ends_sha256=tree.ends[x] or _NOTHING)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Equal neighbours as one: ids, sizes, members, least conv_id and the digest of all their conv_ids."""
    now, sizes, members, least, digest = None, None, 0, 0, None
    for batch in batches:
        for conv_id, ids, bytes_ in zip(batch["conv_id"].to_pylist(), batch["ids"].to_pylist(), batch["sizes"].to_pylist()):
            if ids == now:
                members += 1
                digest.update(b",%d" % conv_id)
                continue
            if now is not None:
                yield now, sizes, members, least, digest.hexdigest()
            now, sizes, members, least, digest = ids, bytes_, 1, conv_id, hashlib.sha256(b"%d" % conv_id)
    if now is not None:
        yield now, sizes, members, least, digest.hexdigest()


def shard_nodes(shard_turns: int):
    """The work of one task: sorted sequences in, nodes, links and boundary nodes out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seam, block, held = Seam(TaskContext.get().partitionId(), True), [], 0
        for sequence in _distinct(batches):
            block.append(sequence)
            held += len(sequence[0]) + 1
            if held >= shard_turns:
                _add_shard(seam, block)
                yield seam.given()
                block, held = [], 0
        if block:
            _add_shard(seam, block)
        seam.end()
        yield seam.given()
    return run


def _merge_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes of all tasks in range order: two paths for each of them."""
    seam, task, paths = Seam(-1, False), None, ([], [])

    def flush() -> None:
        first, last = paths
        seam.feed(first, last, last[0].depth if last else len(first))

    for batch in batches:
        for row in batch.to_pylist():
            if row["task"] != task:
                if task is not None:
                    flush()
                task, paths = row["task"], ([], [])
            node = _Edge(None, row["turn"], row["bytes"], row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"], row["ends_sha256"])
            node.aliases, node.depth = [(row["task"], row["ref"])], row["depth"]
            paths[row["place"]].append(node)
        yield seam.given()
    if task is not None:
        flush()
    seam.end()
    yield seam.given()


class _Edge(_Open):
    __slots__ = ("depth",)


def trie_nodes(sequences: DataFrame, scratch: Scratch, shard_turns: int = SHARD_TURNS, tasks: int | None = None) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, ids, sizes; stored): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    if tasks is None:
        turns = sequences.agg(F.sum(F.size("ids") + F.lit(1).cast("long"))).first()[0] or 0
        tasks = max(1, -(-turns // TASK_TURNS), min(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // 1000))
    ranged = sequences.repartitionByRange(tasks, F.slice("ids", 1, ORDERED)).sortWithinPartitions("ids", "conv_id")
    found = scratch.put(ranged.mapInArrow(shard_nodes(shard_turns), _SPARK_ROWS), "found")
    # Two paths for each task, in range order: what passes here grows with the number of tasks, not with their rows.
    edges = found.where(F.col("kind") == _EDGE).repartition(1).sortWithinPartitions("task", "place", "depth")
    merged = scratch.put(edges.mapInArrow(_merge_tasks, _SPARK_ROWS), "merged")
    rows = found.unionByName(merged)
    links = rows.where(F.col("kind") == _LINK).select("task", F.col("ref").alias("parent_ref"), F.col("conv_id").alias("up"))
    nodes = rows.where(F.col("kind") == _NODE).join(links, ["task", "parent_ref"], "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, tasks: int | None = None) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, from the textless root.

    Null roles and texts are empty. Turns that share a number, or have none, go by the digest of role and text; repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. Conversations without turns are members of the root. An
    empty table has no members and gives no rows. Other columns are not read. A conversation is one row of numbers (16 bytes a
    turn), and the digest of equal conversations runs over their identifiers in one task, without holding them.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.put(numbered_turns(conversations, scratch), "numbered")
    sequences = scratch.put(rebuilt(turns), "sequences")
    return scratch.keep(trie_nodes(sequences, scratch, shard_turns, tasks))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


# CRC-32 of the decimal number: its codes one by one, each followed by eight shifts (-1).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS home, {_CRC.format(c='conv_id')} % {FORKS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.home AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
r AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, p) AS path FROM s GROUP BY 1),
w AS (SELECT conv_id, coalesce(path, []) AS path FROM c LEFT JOIN r USING (conv_id)),
m AS (SELECT conv_id, len(path) AS n, d, list_slice(path, 1, d) AS path FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM w)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM m GROUP BY 1, 2),
kids AS (SELECT list_slice(path, 1, d - 1) AS path, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[node.d].text) END AS saved FROM node LEFT JOIN kids USING (path, d)),
up AS (SELECT list_slice(path, 1, k) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_node n JOIN up ON up.path = n.path LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.path = list_slice(n.path, 1, n.d - 1)
"""
