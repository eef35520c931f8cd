"""The conversation trie against a plain dictionary of prefixes and against its SQL."""

import hashlib
import random
import zlib

import cases
import duckdb
import pytest

from flowcast.llm import conversation_trie
from flowcast.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, id string, bytes string, task string, digest string, home string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows, parts=3):
    data = [(*row, "?", "?", "?", "?", "?") for row in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_nodes(paths):
    """paths: conv_id to a tuple of (role, text)."""
    members = {}
    for conv_id, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv_id)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, ids in members.items():
        ends = ",".join(str(i) for i in sorted(i for i in ids if paths[i] == path))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def plain(rows):
    said = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            said.setdefault(conv_id, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    said = {c: [x[3] for x in sorted(turns)] for c, turns in said.items()}
    paths = {}
    for c, turns in said.items():
        h, home = zlib.crc32(str(c).encode()) % 9, int(c / 5) * 5
        paths[c] = tuple(said.get(home, [])[:h] + turns[h:])
    return plain_nodes(paths)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        size = rng.choice([1, 2, 3, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "why", "éé", "", None, "x" * 50])) for t in range(size)]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(0, 50, 5) for t in range(4)]  # equal conversations of many families
    rows += [(301, None, "user", "null first"), (301, 0, "user", "later"), (301, 0, "user", "later"), (301, 0, "a", "tie"), (None, 1, "user", "nobody's")]
    rows += [(400, t, "user", "long") for t in range(700)] + [(-7, t, "user", str(t)) for t in range(9)]
    return rows


def test_nodes_of_odd_conversations(spark, tmp_path):
    rows = conversations(1)
    want = plain(rows)
    df = frame(spark, rows)
    assert cases.rows_of(conversation_trie.prefix_trie(df), *COLUMNS) == want
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duck.execute(conversation_trie.SQL).fetchall(), key=repr) == want


@pytest.mark.parametrize("shard_turns, tasks", [(1, 1), (7, 1), (40, 9), (10_000, 5), (3, 30)])
def test_boundary_nodes_of_shards_and_tasks(spark, shard_turns, tasks):
    rng = random.Random(shard_turns)
    paths = {c: tuple(("u", rng.choice("abc")) for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))) for c in range(300)}
    number = {turn: n for n, turn in enumerate([("u", x) for x in "abc"])}
    rows = [(c, [number[t] for t in path], [1 for _ in path]) for c, path in paths.items()]
    scratch = Scratch(spark, "trie-test")
    sequences = scratch.put(spark.createDataFrame(rows, "conv_id long, ids array<long>, sizes array<long>"), "sequences")
    got = conversation_trie.trie_nodes(sequences, scratch, shard_turns, tasks)
    assert cases.rows_of(got, *COLUMNS) == plain_nodes(paths)


def test_search_tree_is_balanced():
    tree = conversation_trie.Tree([([n], [1], 1, n, "e") for n in range(1000)])
    depth, deepest = {tree.down[0]: 1}, 0
    waiting = [tree.down[0]]
    while waiting:
        x = waiting.pop()
        deepest = max(deepest, depth[x])
        for child in (tree.low[x], tree.high[x]):
            if child >= 0:
                depth[child] = depth[x] + 1
                waiting.append(child)
    assert deepest == 10


def test_no_conversations(spark):
    assert conversation_trie.prefix_trie(frame(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
