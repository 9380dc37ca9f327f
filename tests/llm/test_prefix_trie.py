import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from contentspark.llm import prefix_trie, registry

KIND = "conv_id long, turn long, role string, text string, depth long, key string"


def symbol_order(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), len(text.encode())


def ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, symbol_order(role, text), role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}


def rebuilt(rows):
    own, out = ordered(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (c - int(c / 5) * 5), [])[:h] + own[c][h:]
    return out


def brute(paths):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def table(rng, convs, turns, texts):
    out = []
    for c in rng.sample(range(-20, 5 * convs), convs):
        kind = rng.random()
        n = 0 if kind < 0.05 else rng.randint(1, turns)
        # Half of the conversations say the same first things.
        out += [(c, t, "u" if t % 2 else "a", "start" * 3 if kind > 0.5 and t < 4 else rng.choice(texts), 1, "k") for t in range(n)]
        if kind < 0.05:
            out.append((c, None, None, None, None, None))
    return out


def got(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


def query(spark, tmp_path, rows):
    path = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return registry.op11_conversation_trie(spark, str(path))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = table(rng, 150, 12, ["", "yes", "no", "ä" * 40, "x"])
    rows += [(None, 1, "u", "lost", 0, ""), (0, None, "u", "null first", 0, ""), (0, 3, None, None, 0, ""), (0, 3, None, None, 0, ""),
             (5, 2, "u", "tie", 0, ""), (5, 2, "a", "tie", 0, "")]
    frame = query(spark, tmp_path, rows)
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(frame) == brute(rebuilt(rows))


def test_empty_and_single(spark, tmp_path):
    assert got(query(spark, tmp_path, [])) == []
    rows = [(7, 1, "u", "hello", 0, "")]
    assert got(query(spark, tmp_path, rows)) == brute(rebuilt(rows))


@pytest.mark.parametrize("shard, text", [(1, 1), (400, 10), (4000, 1 << 20)])
def test_many_small_shards(spark, monkeypatch, shard, text):
    """Whatever the size of shards and id pieces, several levels give the same nodes."""
    rng = random.Random(shard)
    paths = {}
    for c in range(1500):
        n = rng.choice([0, 1, 2, 3, 3, 3, 9, 70])
        paths[c] = [("u", "same") if rng.random() < 0.7 else ("a", rng.choice(["yes", "no", ""])) for _ in range(n)]
    rows = [(c, i, r, t) for c, turns in paths.items() for i, (r, t) in enumerate(turns)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    without = {c: x for c, x in paths.items() if x}
    # Task functions travel by value with their module's settings.
    for name, value in (("SHARD_BYTES", shard), ("_TEXT_BYTES", text), ("LEAST_PATHS", 4)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert got(prefix_trie.prefix_trie(lists.repartition(5), shard_bytes=max(shard, 100))) == brute(without)


def test_parentheses_against_a_stack():
    rng = random.Random(2)
    for size in (1, 5, 40, 700, 5000):
        bits, depth, left = [1], 1, size
        while depth:
            if left and (rng.random() < 0.55 or depth == 1):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                if depth == 1 and left:
                    continue
                bits.append(0)
                depth -= 1
        tree = prefix_trie.Parentheses(np.array(bits, np.int8))
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        ends = tree.findclose(tree.opens)
        assert ends.tolist() == [close[i] for i in tree.opens.tolist()]
        pairs = [sum(bits[k] == 1 and bits[k + 1] == 0 for k in range(i, close[i])) for i in tree.opens[:50].tolist()]
        assert tree.pairs_between(tree.opens, ends)[:50].tolist() == pairs
        assert tree.opens_until(ends).tolist() == [sum(bits[: e + 1]) for e in ends.tolist()]
