"""Merkle manifest of a dataset: a tree of SHA-256 midstates, kept so that a changed row folds to the root by resuming them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import empty_like, ordered_prefix
from flowdrift.session import materialize

BLOCK = 4096  # leaves of a subtree that one task builds, at most


# --- SHA-256 over many messages at once. A state is an array (8, n), a block (16, n), of 32-bit words. ---


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


# The standard's constants: 32 bits of the fractional parts of the roots of the first primes.
_START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block of 64 bytes each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _hex_words(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their 64 lowercase hex digits."""
    out = np.zeros((16, digest.shape[1]), np.uint32)
    for k in range(16):
        half = digest[k // 2] >> np.uint32(16 if k % 2 == 0 else 0)
        for shift in (12, 8, 4, 0):
            digit = (half >> np.uint32(shift)) & np.uint32(15)
            out[k] = (out[k] << np.uint32(8)) | (digit + np.uint32(48) + np.uint32(39) * (digit > 9))
    return out


def _padding(children: np.ndarray) -> np.ndarray:
    """The last block of messages of so many digests."""
    out = np.zeros((16, len(children)), np.uint32)
    out[0], out[15] = 0x80000000, children * 512
    return out


def _from_hex(text: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(text)), ">u4").astype(np.uint32).reshape(-1, 8).T


def _to_bytes(digest: np.ndarray) -> bytes:
    return digest.T.astype(">u4").tobytes()


def _to_hex(digest: np.ndarray) -> list[str]:
    text = _to_bytes(digest).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8).T


# --- subtrees ---


def _height(n: int, fanout: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def build_levels(digest: np.ndarray, levels: int, fanout: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level above ``digest`` (8, n): the parents' digests (8, m) and the states (fanout - 1, 8, m) copied
    before each child slot after the first; before the first one it is the hash's own start."""
    out = []
    for _ in range(levels):
        n = digest.shape[1]
        parents = -(-n // fanout)
        state = np.repeat(_START[:, None], parents, axis=1)
        kept = np.zeros((fanout - 1, 8, parents), np.uint32)
        for slot in range(fanout):
            if slot:
                kept[slot - 1] = state
            child = digest[:, slot::fanout]
            if child.shape[1]:
                state[:, : child.shape[1]] = compress(state[:, : child.shape[1]], _hex_words(child))
        children = np.minimum(n - np.arange(parents) * fanout, fanout).astype(np.uint32)
        digest = compress(state, _padding(children))
        out.append((digest, kept))
    return out


def fold_levels(digest: np.ndarray, at: np.ndarray, below: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], fanout: int) -> np.ndarray:
    """Replace the leaves ``at`` of ``below`` by ``digest``, each alone, and return what the subtree's top becomes.

    At each parent the state before the leaf's slot is resumed with the replacement and the siblings to its right.
    """
    for above, kept in levels:
        n, parent, slot = below.shape[1], at // fanout, at % fanout
        state = np.repeat(_START[:, None], len(at), axis=1)
        later = np.flatnonzero(slot)
        state[:, later] = kept[slot[later] - 1, :, parent[later]].T
        state = compress(state, _hex_words(digest))
        for k in range(1, fanout):
            more = np.flatnonzero((slot + k < fanout) & (at + k < n))
            if len(more):
                state[:, more] = compress(state[:, more], _hex_words(below[:, at[more] + k]))
        digest = compress(state, _padding(np.minimum(n - parent * fanout, fanout).astype(np.uint32)))
        at, below = parent, above
    return digest


def fold_path(digest: np.ndarray, path: list[dict]) -> np.ndarray:
    """Fold ``digest`` (8, n) up one path: resume each state, add the replacement and the right siblings, close."""
    for step in path:
        state = compress(np.repeat(_from_bytes(step["state"]), digest.shape[1], axis=1), _hex_words(digest))
        for k in range(0, len(step["right"]), 64):
            right = np.repeat(_from_hex([step["right"][k : k + 64]]), digest.shape[1], axis=1)
            state = compress(state, _hex_words(right))
        children = (len(step["left"]) + len(step["right"])) // 64 + 1
        digest = compress(state, _padding(np.full(digest.shape[1], children, np.uint32)))
    return digest


def _steps(at: int, below: list[list[str]], levels: list[tuple[np.ndarray, np.ndarray]], fanout: int) -> list[dict]:
    out = []
    for hexes, (_, kept) in zip(below, levels, strict=True):
        first, slot = at - at % fanout, at % fanout
        state = _START[:, None] if slot == 0 else kept[slot - 1][:, [at // fanout]]
        out.append(
            {"state": _to_bytes(state), "left": "".join(hexes[first:at]), "right": "".join(hexes[at + 1 : first + fanout])}
        )
        at //= fanout
    return out


# --- the tree as tables ---

PATH = T.ArrayType(
    T.StructType([T.StructField("state", T.BinaryType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
)
_LEVELS = T.ArrayType(T.StructType([T.StructField("digests", T.BinaryType()), T.StructField("states", T.BinaryType())]))


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _L = T.StringType(), T.LongType()
_BLOCKS = _fields(g=_S, block=_L, n=_L, top=_S, levels=_LEVELS)


def _numbered(df: DataFrame, order: list[Column], group: Column) -> DataFrame:
    """``df`` stored with ``i`` (place in the group by ``order``) and ``n`` (size of the group). No task holds a group."""
    rows, sums = ordered_prefix(df, [group, *order], group, F.lit(1))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    parts = sums.select(
        F.col("_part").alias("_p"),
        F.col("_group").alias("_g"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
        F.sum("_n").over(whole).alias("n"),
    )
    out = rows.join(parts, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return out.select(*df.columns, (F.col("_before") + F.col("_shift")).alias("i"), "n")


@dataclass
class Tree:
    """Rounds of (leaves, blocks): the blocks of a round are the leaves of the next one; ``tops`` has one row (g, top) a group."""

    fanout: int
    per_block: int
    rounds: list[tuple[DataFrame, DataFrame]]
    tops: DataFrame


def _in_blocks(leaves: DataFrame, per_block: int):
    return leaves.withColumn("block", F.floor(F.col("i") / F.lit(per_block)).cast("long"))


def build_tree(leaves: DataFrame, fanout: int = 2) -> Tree:
    """One tree for each group of ``leaves`` (g, i, n, digest). Aligned blocks of leaves are built apart, round by round."""
    if fanout < 2:
        raise ValueError("a parent needs two children at least")
    deep = 1
    while fanout ** (deep + 1) <= BLOCK:
        deep += 1
    per_block = fanout**deep
    arrow = empty_like(_BLOCKS)

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.select(["g", "block", "i", "n", "digest"]).sort_by("i")
        n = rows["n"][0].as_py()
        digest = _from_hex(rows["digest"].to_pylist())
        levels = build_levels(digest, min(deep, _height(n, fanout)), fanout)
        top = levels[-1][0] if levels else digest
        packed = [{"digests": _to_bytes(d), "states": b"".join(_to_bytes(s) for s in kept)} for d, kept in levels]
        return pa.Table.from_pylist(
            [{"g": rows["g"][0].as_py(), "block": rows["block"][0].as_py(), "n": n, "top": _to_hex(top)[0], "levels": packed}], arrow
        )

    rounds, tops = [], None
    while True:
        leaves = _in_blocks(leaves, per_block)
        blocks = materialize(leaves.select("g", "block", "i", "n", "digest").groupBy("g", "block").applyInArrow(block, _BLOCKS))
        rounds.append((leaves, blocks))
        done = blocks.filter(F.col("n") <= per_block).select("g", "top")
        tops = done if tops is None else tops.union(done)
        rest = blocks.filter(F.col("n") > per_block)
        if rest.isEmpty():
            return Tree(fanout, per_block, rounds, tops)
        leaves = rest.select("g", F.col("block").alias("i"), F.ceil(F.col("n") / F.lit(per_block)).alias("n"), F.col("top").alias("digest"))


def _unpack(levels: list[dict], fanout: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for x in levels:
        digest = _from_bytes(x["digests"])
        flat = _from_bytes(x["states"])  # slot by slot
        out.append((digest, flat.reshape(8, fanout - 1, -1).transpose(1, 0, 2)))
    return out


def _descend(tree: Tree, up: DataFrame, visit, schema: T.StructType) -> DataFrame:
    """``visit`` for the leaves of every block of every round, from the last to the first one, with the block's path.

    ``up`` has (g, path, subroot) for each group. ``visit(rows, block, fanout)`` gets one block's leaves and returns
    a table of ``schema``; only for the first round, the others return paths.
    """
    fanout, per_block = tree.fanout, tree.per_block
    on = _fields(g=_S, block=_L, path=PATH, subroot=_S)
    arrow = empty_like(on)

    def paths(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, known = rows.sort_by("i"), found.select(["levels", "path", "subroot"]).to_pylist()[0]
        levels = _unpack(known["levels"], fanout)
        digest = _from_hex(rows["digest"].to_pylist())
        below = [_to_hex(x) for x in [digest, *(d for d, _ in levels)][: len(levels)]]
        out = [
            {"g": g, "block": i, "path": _steps(k, below, levels, fanout) + known["path"], "subroot": known["subroot"]}
            for k, (g, i) in enumerate(zip(rows["g"].to_pylist(), rows["i"].to_pylist(), strict=True))
        ]
        return pa.Table.from_pylist(out, arrow)

    def last(rows: pa.Table, found: pa.Table) -> pa.Table:
        known = found.select(["levels", "path", "subroot"]).to_pylist()[0]
        return visit(rows.sort_by("i"), _unpack(known["levels"], fanout), known["path"], known["subroot"], fanout)

    above = None
    for k, (leaves, blocks) in reversed(list(enumerate(tree.rounds))):
        tops = blocks.filter(F.col("n") <= per_block).select("g", "block").join(up, "g").select("g", "block", "path", "subroot")
        above = tops if above is None else tops.union(above)
        known = blocks.select("g", "block", "levels").join(above, ["g", "block"])
        pairs = leaves.groupBy("g", "block").cogroup(known.groupBy("g", "block"))
        if k == 0:
            return pairs.applyInArrow(last, schema)
        above = materialize(pairs.applyInArrow(paths, on))
    raise AssertionError("a tree has a round")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    return F.sha2(F.concat(*(_part(c) for c in columns)), 256)


@dataclass
class Manifest:
    """Trees of the groups, the tree over their subroots, and the root (null for an empty table)."""

    groups: Tree
    top: Tree
    root: str | None

    def subroots(self) -> DataFrame:
        """Rows (g, subroot): a null group is '', another one '=' and its value."""
        return self.groups.tops.withColumnRenamed("top", "subroot")

    def group_paths(self) -> DataFrame:
        """Rows (g, path, subroot): the states and siblings from each subroot to the root."""
        top = self.top.rounds[0][0]
        start = top.select("g").limit(1).select("g", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
        schema = _fields(g=_S, path=PATH, subroot=_S)
        arrow = empty_like(schema)

        def visit(rows: pa.Table, levels, path, _, fanout: int) -> pa.Table:
            hexes = rows["digest"].to_pylist()
            below = [hexes, *(_to_hex(d) for d, _ in levels)][: len(levels)]
            out = [
                {"g": g, "path": _steps(k, below, levels, fanout) + path, "subroot": hexes[k]}
                for k, g in enumerate(rows["of"].to_pylist())
            ]
            return pa.Table.from_pylist(out, arrow)

        return materialize(_descend(self.top, start, visit, schema))

    def audited(self, paths: bool = False) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

        ``folded_root`` folds the ``replacement`` digest of the leaf to the root: in its block, then on the block's
        path. With ``paths`` there is also the whole ``path`` (state, left and right siblings for each level).
        """
        root = self.root
        fields = _fields(doc_id=_L, leaf=_S, subroot=_S, root=_S, proof_sha256=_S, folded_root=_S, verified=T.BooleanType())
        schema = T.StructType([*fields.fields, T.StructField("path", PATH)]) if paths else fields
        arrow = empty_like(schema)

        def visit(rows: pa.Table, levels, path: list[dict], subroot: str, fanout: int) -> pa.Table:
            leaves = rows["digest"].to_pylist()
            digest, n = _from_hex(leaves), len(leaves)
            top = fold_levels(_from_hex(rows["replacement"].to_pylist()), np.arange(n), digest, levels, fanout)
            # leaves that were not replaced arrive at one and the same top; each different top is carried on once
            tops, which = np.unique(top, axis=1, return_inverse=True)
            folded = _to_hex(fold_path(tops, path))
            folded = [folded[k] for k in which.reshape(-1)]
            siblings = []
            for hexes in [leaves, *(_to_hex(d) for d, _ in levels)][: len(levels)]:
                runs = [hexes[i : i + fanout] for i in range(0, len(hexes), fanout)]
                siblings.append(["".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
            upper = "".join(step["left"] + step["right"] for step in path)
            proof = []
            for k in range(n):
                own, at = [], k
                for level in siblings:
                    own.append(level[at])
                    at //= fanout
                proof.append(hashlib.sha256(("".join(own) + upper).encode()).hexdigest())
            out = {
                "doc_id": rows["doc_id"], "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof,
                "folded_root": folded, "verified": [x == root for x in folded],
            }
            if paths:
                below = [leaves, *(_to_hex(d) for d, _ in levels)][: len(levels)]
                out["path"] = [_steps(k, below, levels, fanout) + path for k in range(n)]
            return pa.table(out, schema=arrow)

        return _descend(self.groups, self.group_paths(), visit, schema)


def manifest(docs: DataFrame, group: str, key: str, leaf: Column, replacement: Column | None = None, fanout: int = 2) -> Manifest:
    """Merkle tree over the rows of ``docs``: a tree for each value of ``group``, then one over their subroots.

    ``leaf`` is the digest of a row, ``replacement`` the one that ``Manifest.audited`` folds in its place (the leaf
    itself by default). Leaves of a group ascend by ``key`` (null first), equal keys by their digest. At each level
    every ``fanout`` consecutive nodes, the last ones possibly fewer and even one, become the hash of their hex
    digests; a lone leaf is its own subroot. Subroots ascend by group, null first, and are joined likewise.

    A parent keeps the copied hash state before each child slot, so folding a changed child resumes the state of
    its slot and reads only the siblings to the right. 64 hex digits are one block of the hash, so each copied
    state is a plain midstate of 32 bytes that can be stored.

    Only digests are sorted, never the rows. Blocks of 4096 leaves are built by different tasks, so a group may
    hold any share of the rows. Nulls in hashed columns are part of the leaf; equal rows are separate leaves; an
    empty table has no root and no rows. Other columns of ``docs`` have no effect.
    """
    of = F.col(group)
    rows = docs.select(
        F.when(of.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), of.cast("string"))).alias("g"),
        F.col(key).cast("long").alias("doc_id"),
        leaf.alias("digest"),
        (leaf if replacement is None else replacement).alias("replacement"),
    )
    leaves = materialize(_numbered(rows, [F.col("doc_id"), F.col("digest")], F.col("g")))
    groups = build_tree(leaves, fanout)
    subroots = groups.tops.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("digest"))
    top = build_tree(_numbered(subroots, [F.col("of")], F.col("g")), fanout)
    end = top.tops.first()
    return Manifest(groups, top, end["top"] if end else None)


def audited_documents(docs: DataFrame) -> DataFrame:
    """Manifest of documents by language. In rows whose id has a CRC that 7 divides, ``n_chars`` is tampered with.

    See ``manifest`` for order, nulls, ties and empty tables. A null id is never tampered with; a null ``n_chars``
    stays null, so such a row still verifies.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_digest([F.col(c) for c in columns])
    changed = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, "lang", "doc_id", leaf, F.when(hit, changed).otherwise(leaf)).audited()
