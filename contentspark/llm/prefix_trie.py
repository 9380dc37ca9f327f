"""Prefix trie of conversations: how many share each beginning, and what storing shared turns once would save.

A conversation is the sequence of its turns, each a digest of role and text with the length of the text, so texts never
meet in one place. Conversations are sorted by that sequence and dealt by range, equal ones by their ids as well; a task
reads a stretch of them in order and cuts it into shards of bounded size. Each shard is a trie in balanced parentheses:

* an opening and a closing bit for each node, in the order of a walk, with the running excess of opening over closing
  bits and the least excess of each block of bits in a tree of minima;
* `findclose` follows that tree to the bit that closes a node, which delimits the node's subtree;
* the rank of "()" pairs counts the leaves of a subtree, and cumulative arrays in the order of opening bits give the
  members and the savings.

Only the nodes on a shard's first and last path, its spines, can occur in other shards. They are handed on with what
hangs from them, sorted again and merged in shards of their own, level by level, until one shard is left; every level is
a stored table, and there is one driver decision a level. A very common beginning or conversation is therefore spread
over many shards. The ids of one node's members are hashed as a stream of ordered pieces.

Rows without a conversation id are left out; a null role or text counts as empty; turns are ordered by turn, null first,
and equal ones by their digest; a repeated row is a turn of its own. An empty table has no node, not even a root. Turns
are told apart by md5 and length. A task holds the 20-byte digests of one conversation at a time, sixteen of them at least
where they are longer than a shard.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import stored

#: Bytes of a turn in a path: md5 of role and text, then the text's length in bytes, big-endian.
SYMBOL = 20
SHARD_BYTES = 2 << 20
LEAST_PATHS = 16
BLOCK = 64

_TEXT_BYTES = 1 << 20
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A sequence of balanced opening (1) and closing (0) bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            level = self.minima[-1]
            if len(level) % 2:
                level = np.append(level, np.iinfo(np.int32).max)
            self.minima.append(np.minimum(level[::2], level[1::2]))
        self.opens = np.flatnonzero(bits)
        pairs = np.zeros(len(bits) + 1, np.int64)
        pairs[1:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self._pairs = np.cumsum(pairs)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The bit that closes each opening bit: the next one where the excess falls below."""
        goal, out = self.excess[at], np.full(len(at), -1, np.int64)
        for a in range(0, len(at), 1 << 14):
            part = slice(a, a + (1 << 14))
            row = at[part] // BLOCK
            hit = (self.blocks[row] < goal[part][:, None]) & (np.arange(BLOCK) > (at[part] % BLOCK)[:, None])
            out[part] = np.where(hit.any(axis=1), row * BLOCK + hit.argmax(axis=1), -1)
        left = np.flatnonzero(out < 0)
        node, level_of = at[left] // BLOCK, np.full(len(left), -1)
        for level, minima in enumerate(self.minima):
            # Up to the first right neighbour that falls far enough ...
            up = np.flatnonzero(level_of < 0)
            beside = node[up] + 1
            falls = (node[up] % 2 == 0) & (beside < len(minima)) & (minima[np.minimum(beside, len(minima) - 1)] < goal[left[up]])
            node[up] = np.where(falls, beside, node[up] // 2)
            level_of[up[falls]] = level
        for level in range(len(self.minima) - 1, 0, -1):
            # ... and down to the first block in it.
            down = np.flatnonzero(level_of == level)
            first = self.minima[level - 1][2 * node[down]] < goal[left[down]]
            node[down] = 2 * node[down] + ~first
            level_of[down] = level - 1
        out[left] = node * BLOCK + (self.blocks[node] < goal[left][:, None]).argmax(axis=1)
        return out

    def opens_until(self, at: np.ndarray) -> np.ndarray:
        """How many opening bits there are up to each bit, that one included."""
        return (at + 1 + self.excess[at]) // 2

    def pairs_between(self, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """How many "()" pairs lie in each bracket, counted by rank."""
        return self._pairs[closing] - self._pairs[opening]


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    table = [values]
    while 2 ** len(table) <= len(values):
        width = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
    level = np.log2(stop - start).astype(np.int64)
    out = np.empty(len(start), np.int64)
    for k, row in enumerate(table):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(row[start[here]], row[stop[here] - 2**k])
    return out


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the start."""
    size = min(len(a), len(b)) // SYMBOL * SYMBOL
    if a[:SYMBOL] != b[:SYMBOL] or not size:
        return 0
    differ = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
    k = int(differ.argmax())
    return (k if differ[k] else size) // SYMBOL


_LOCAL = ("members", "least", "saved", "leaves", "children")
#: The same along a whole path, in a column each.
_ALONG = [f"{name}_along" for name in _LOCAL]
_COLUMNS = {
    "kind": pa.string(), "shard": pa.int64(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "parent_node": pa.binary(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved": pa.int64(), "ends": pa.string(), "node": pa.binary(), "key": pa.binary(),
    **{name: pa.list_(pa.int64()) for name in _ALONG}, "first": pa.int64(), "ids": pa.binary()}
_SCHEMA = ("kind string, shard long, conv_id long, depth long, parent_conv_id long, parent_node binary, n_convs long, "
           "n_children long, n_leaves long, saved long, ends string, node binary, key binary, "
           + ", ".join(f"{name} array<long>" for name in _ALONG) + ", first long, ids binary")


def _rows(kind: str, shard: int, count: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": [kind] * count, "shard": [shard] * count}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], t) if n in columns else pa.nulls(count, t) for n, t in _COLUMNS.items()], names=list(_COLUMNS))


def _prefix_digests(key: bytes, depths) -> dict[int, bytes]:
    """md5 of the beginning of a path for each depth asked for, in one pass."""
    out, h, at = {}, hashlib.md5(usedforsecurity=False), 0
    for depth in sorted(depths):
        h.update(key[at * SYMBOL: depth * SYMBOL])
        out[depth], at = h.digest(), depth
    return out


class Shard:
    """Paths in order, with what each contributes to the nodes along it."""

    def __init__(self, number: int):
        self.number = number
        self.keys: list[bytes] = []
        self.shared: list[int] = []
        self.given: list = []
        self.digests: list[str | None] = []
        self.bytes = 0

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES and len(self.keys) >= LEAST_PATHS

    def add(self, key: bytes, given) -> None:
        """A path after the last one; given is [members, least] of its end, or arrays for all of its nodes."""
        common = _common(self.keys[-1], key) if self.keys else 0
        self.bytes += len(key) - common * SYMBOL + SYMBOL
        self.keys.append(key)
        self.shared.append(common)
        self.given.append(given)
        self.digests.append(None)

    def rows(self, last: bool):
        """Finished nodes and, unless this is the last shard of all, the two spines."""
        lengths = np.array([len(k) // SYMBOL for k in self.keys])
        shared = np.array(self.shared)
        fresh = lengths - shared
        fresh[0] += 1
        closing = np.append(np.append(0, lengths[:-1] - shared[1:]), lengths[-1] + 1)
        counts = np.stack([closing, np.append(fresh, 0)], axis=1).ravel()
        tree = Parentheses(np.repeat(np.tile(np.array([0, 1], np.int8), len(fresh) + 1), counts))
        total = len(tree.opens)
        depth = (tree.excess[tree.opens] - 1).astype(np.int64)
        symbols = b"".join(k[s * SYMBOL:] for k, s in zip(self.keys, self.shared))
        weight = np.zeros(total, np.int64)
        weight[1:] = np.frombuffer(symbols, np.uint8).reshape(-1, SYMBOL)[:, 16:].copy().view(">u4").ravel()

        local = {name: np.zeros(total, np.int64) for name in _LOCAL}
        local["least"][:] = _NONE
        parent = np.arange(total) - 1
        ends = np.zeros(len(self.keys), np.int64)
        spine, spines, at = np.zeros(int(lengths.max()) + 1, np.int64), [], 1
        for i, (s, n, given) in enumerate(zip(self.shared, lengths.tolist(), self.given)):
            if n > s:
                parent[at] = spine[s]
                spine[s + 1: n + 1] = np.arange(at, at + n - s)
                at += n - s
            ends[i] = spine[n]
            if len(given) != 2:
                path = spine[: n + 1]
                for name, values in zip(_LOCAL, given):
                    local[name][path] = np.minimum(local[name][path], values) if name == "least" else local[name][path] + values
            if i in (0, len(self.keys) - 1):
                spines.append(spine[: n + 1].copy())
        if len(self.given[0]) == 2:
            given = np.array(self.given, np.int64)
            np.add.at(local["members"], ends, given[:, 0])
            np.minimum.at(local["least"], ends, given[:, 1])

        start = np.arange(total)
        closes = tree.findclose(tree.opens)
        stop = tree.opens_until(closes)

        def below(values: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(values))
            return sums[stop] - sums[start]

        # A pair with children in earlier levels only looks like a leaf; those children have brought their own leaves.
        bare = (stop - start == 1) & (local["children"] > 0)
        members = below(local["members"])
        own = (members - 1) * weight
        saved = below(local["saved"] + own)
        leaves = tree.pairs_between(tree.opens, closes) - below(bare) + below(local["leaves"])
        children = local["children"] + np.bincount(parent[1:], minlength=total)
        least = _range_minima(local["least"], start, stop)

        on_spine = np.zeros(total, bool)
        if not last:
            for path in spines:
                on_spine[path] = True
        done = np.flatnonzero(~on_spine)
        path_of = np.searchsorted(np.append(0, np.cumsum(fresh)), np.arange(total), "right") - 1
        ends_of = [_EMPTY] * total
        ask: dict[int, set] = {}
        for i, (node, digest) in enumerate(zip(ends.tolist(), self.digests)):
            ends_of[node] = digest
            if digest is None:
                ask.setdefault(node, set())
        if len(self.given[0]) != 2:
            ask = {node: set() for node in done.tolist()}
        # Digests of finished nodes whose members' ids are merged elsewhere, and of spine nodes with finished children.
        named = {n for n in ask if not on_spine[n]}
        orphans = done[on_spine[parent[done]] & (done > 0)]
        named |= set(parent[orphans].tolist())
        # A path in the middle of a shard may end on a spine; all of its members are known here.
        settled = {n: d for n, d in zip(ends.tolist(), self.digests) if d is not None and on_spine[n]}
        named |= set(settled)
        by_path: dict[int, list[int]] = {}
        for node in named:
            by_path.setdefault(int(path_of[node]), []).append(node)
        digest_of: dict[int, bytes] = {}
        for i, nodes in by_path.items():
            found = _prefix_digests(self.keys[i], {int(depth[n]) for n in nodes})
            digest_of.update((n, found[int(depth[n])]) for n in nodes)

        for a in range(0, len(done), 1 << 14):
            some = done[a: a + (1 << 14)]
            nodes, ups = some.tolist(), parent[some].tolist()
            yield _rows(
                "node", self.number, len(some), conv_id=least[some], depth=depth[some],
                parent_conv_id=[None if n == 0 or on_spine[u] else int(least[u]) for n, u in zip(nodes, ups)],
                parent_node=[digest_of[u] if n and on_spine[u] else None for n, u in zip(nodes, ups)],
                n_convs=members[some], n_children=children[some], n_leaves=leaves[some], saved=saved[some],
                ends=[None if n in ask else ends_of[n] for n in nodes], node=[digest_of[n] if n in ask else None for n in nodes])
        if settled:
            yield _rows("digest", self.number, len(settled), node=[digest_of[n] for n in settled], ends=list(settled.values()))
        if last:
            return
        # What a spine node hands on is its subtree without the spine nodes below it.
        links = np.flatnonzero(on_spine)[1:]
        leaf = (stop - start == 1) & ~bare

        def without(values: np.ndarray, of_child: np.ndarray) -> np.ndarray:
            out = values.copy()
            np.subtract.at(out, parent[links], of_child[links])
            return out

        handed = {
            "members": without(members, members), "least": least, "saved": without(saved - own, saved),
            "leaves": without(leaves - leaf, leaves), "children": without(children, np.ones(total, np.int64))}
        if len(spines) == 2 and len(np.setdiff1d(spines[1], spines[0])) == 0:
            spines.pop()
        for k, path in enumerate(spines):
            once = np.isin(path, spines[0]) if k else np.zeros(len(path), bool)
            yield _rows("spine", self.number, 1, key=[self.keys[-1 if k else 0]], **{
                f"{name}_along": [np.where(once, _NONE if name == "least" else 0, values[path])] for name, values in handed.items()})


def _numbers(level: int):
    context = TaskContext.get()
    number = (level << 56) + ((context.partitionId() if context else 0) << 28)
    while True:
        yield number
        number += 1


def _pieces(batches):
    """(path, ids) of members in order; a path that goes on in the next batch comes again."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for key, members in groupby(pairs, key=lambda x: x[0]):
            yield key, [m[1] for m in members]


def _first_level(batches):
    """Members sorted by (path, id): shards of them, and pieces of the ids of nodes that may go on in another shard."""
    numbers = _numbers(1)
    shard, text, first, split = Shard(next(numbers)), bytearray(), None, False

    def piece():
        node = hashlib.md5(shard.keys[-1], usedforsecurity=False).digest()
        return _rows("ends", shard.number, 1, node=[node], first=[first], ids=[bytes(text)])

    for key, ids in _pieces(batches):
        if shard.keys and shard.keys[-1] == key:
            shard.given[-1][0] += len(ids)
        else:
            if shard.keys:
                if split or len(shard.keys) == 1 or shard.full():
                    yield piece()
                else:
                    shard.digests[-1] = hashlib.sha256(text).hexdigest()
                if shard.full():
                    yield from shard.rows(False)
                    shard = Shard(next(numbers))
            shard.add(key, [len(ids), ids[0]])
            text, first, split = bytearray(), None, False
        for a in range(0, len(ids), 1 << 16):
            if len(text) > _TEXT_BYTES:
                yield piece()
                text, first, split = bytearray(), None, True
            if first is None:
                first = ids[a]
            text += (b"," if text else b"") + ",".join(map(str, ids[a: a + (1 << 16)])).encode()
    if shard.keys:
        yield piece()
        yield from shard.rows(False)


def _next_level(level: int, last: bool):
    def merged(batches):
        numbers = _numbers(level)
        shard = Shard(next(numbers))
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                if not last and shard.full():
                    yield from shard.rows(False)
                    shard = Shard(next(numbers))
                shard.add(key, [batch.column(1 + k)[i].values.to_numpy(zero_copy_only=False) for k in range(len(_LOCAL))])
        if shard.keys:
            yield from shard.rows(last)

    return merged


def _hashed_ids(batches):
    """(node, ends) of pieces of ids sorted by (node, first id)."""
    node, h, out = None, None, []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends"])

    for batch in batches:
        for here, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if here == node:
                h.update(b",")
            else:
                if h is not None:
                    out.append((node, h.hexdigest()))
                node, h = here, hashlib.sha256()
            h.update(ids.as_py())
        if len(out) > 1 << 14:
            yield batch_of(out)
            out = []
    if h is not None:
        out.append((node, h.hexdigest()))
    yield batch_of(out)


def turn_symbol(role: Column, text: Column) -> Column:
    """The 20 bytes of a turn; a null role or text counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def turn_lists(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the symbols of each conversation's turns in order."""
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        turn_symbol(F.col(role_col), F.col(text_col)).alias("symbol"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "symbol")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["symbol"]).alias("turns"))


def prefix_trie(lists: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved (bytes) and ends, the SHA-256 of the ids of the conversations that end there, in order and joined by commas.

    A node is known by its depth and conv_id, its smallest member. A repeated id is a member each time.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t)), ""))
    members = lists.select(F.coalesce(key, F.lit(b"")).alias("key"), "conv_id")
    levels = [stored(members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_first_level, _SCHEMA))]
    while True:
        spines = levels[-1].where("kind = 'spine'").select("key", *_ALONG)
        count, size = spines.agg(F.count("*"), F.sum(3 * F.octet_length("key") + 60)).first()
        parts = int(min((size or 0) // shard_bytes, count // (4 * LEAST_PATHS))) + 1 if count else 1
        last = parts == 1
        dealt = spines.repartition(1) if last else spines.repartitionByRange(parts, "key")
        levels.append(stored(dealt.sortWithinPartitions("key").mapInArrow(_next_level(len(levels) + 1, last), _SCHEMA)))
        if last:
            break

    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    merged = levels[1]
    for level in levels[2:]:
        merged = merged.unionByName(level)
    answer = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    nodes = every.where("kind = 'node'").select("shard", "parent_node", "node", *answer)

    # A child of a spine node asks for that node's smallest member, once per shard: a very common node is spread by shard.
    spine_ids = merged.where("kind = 'node'").select(F.col("node").alias("parent_node"), F.col("conv_id").alias("of_parent"))
    asked = nodes.where("parent_node is not null").select("shard", "parent_node").distinct().join(spine_ids, "parent_node")
    orphans = nodes.where("parent_node is not null").join(asked, ["shard", "parent_node"]).withColumn(
        "parent_conv_id", F.col("of_parent")).drop("of_parent")
    placed = nodes.where("parent_node is null").unionByName(orphans.select(nodes.columns))

    hashed = levels[0].where("kind = 'ends'").select("node", "ids", "first").repartition("node").sortWithinPartitions(
        "node", "first").select("node", "ids").mapInArrow(_hashed_ids, "node binary, ends string")
    hashed = hashed.unionByName(levels[0].where("kind = 'digest'").select("node", "ends"))
    looked_up = placed.where("node is not null").drop("ends").join(hashed, "node", "left").withColumn(
        "ends", F.coalesce("ends", F.lit(_EMPTY)))
    return placed.where("node is null").select(answer).unionByName(looked_up.select(answer))
