"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation c is rebuilt from the head of its base (the first h turns of conversation c - c % 20)
and its own turns after the first h. No rebuilt text is ever made:

* Every turn is stored once. Turns of equal role and text share a reference, the number of the first
  of them (grouped by the texts themselves).
* A sequence of turns has the fingerprint sum x_i * B^i modulo 2^31 - 1, for four bases B, with x_i
  drawn from the reference. Fingerprints form a monoid: that of a rebuilt prefix is the base's head
  product plus the own suffix product (a difference of prefix sums) shifted by a power of B.
* Prefixes of equal depth and fingerprint form a node. Its members must name one reference for their
  last turn and one fingerprint for their parent; by induction from the root they then are equal turn
  by turn. Should a group not pass, all is done again with other bases.
* Sums over subtrees need no walk over depths: a node counts for its smallest member, whose nodes are
  the lower end of its path; sums from below along that path, and whole sums of the other members, add
  up to the subtree's.

Prefix sums run in blocks of a conversation, so that no conversation meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.common import WORD_GAP, cut_lineage
from reelsift.operators.ranking import global_rank

#: Turns of a base that a conversation takes at most, and conversations to a base.
HEAD, FAMILY = 3, 20
PRIME, BASES = (1 << 31) - 1, 4
#: log2 of the places of a block of prefix sums; ids that are hashed at a time.
BLOCK, IDS = 12, 4096
NODE = ["depth", "a", "b"]


def head_length(conv: Column) -> Column:
    """Turns that a conversation takes from its base: crc32 of its decimal id modulo 4."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def bases(seed: int) -> list[int]:
    draw = np.random.default_rng(seed)
    return [int(x) for x in draw.integers(1 << 20, PRIME - 1, BASES)]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo PRIME."""
    out, square, e = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % np.uint64(PRIME), out)
        square, e = square * square % np.uint64(PRIME), e >> np.uint64(1)
    return out


def _terms(seed: int):
    """x * B^pos of every turn for each base, x from 1 to PRIME - 1 by the turn's reference."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, ref = (batch[c].to_numpy() for c in ("pos", "ref"))
            out = []
            for i, base in enumerate(bases(seed)):
                x = ref.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * BASES + i + 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = (x ^ (x >> np.uint64(31))) % np.uint64(PRIME - 1) + np.uint64(1)
                out.append(pa.array((x * _power(base, pos) % np.uint64(PRIME)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *[f"t{i}" for i in range(BASES)]])
    return go


def prefix_sums(df: DataFrame, key: str, place: str, sums: dict[str, str], modulo: int | None = None) -> DataFrame:
    """``df`` with the sums of the columns ``sums`` (new name: column) over the rows of ``key`` up to and
    with ``place`` (unique there): within blocks of places, plus the blocks before (modulo ``modulo``)."""
    block = df.withColumn("_block", F.shiftright(place, BLOCK))
    inner = Window.partitionBy(key, "_block").orderBy(place)
    part = block.select("*", *[F.sum(c).over(inner).alias(f"_{n}") for n, c in sums.items()])

    def cut(x):
        return x % modulo if modulo else x

    whole = block.groupBy(key, "_block").agg(*[cut(F.sum(c)).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(key, "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    out = part.join(whole, [key, "_block"])
    return out.select(*df.columns, *[cut(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def stored_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, ref, words): every turn's place in its conversation, its reference and the words
    of its text, written once. Turns are ordered by turn (null first), then role and text."""
    turns = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                    F.coalesce("text", F.lit("")).alias("text"))
    ranked = global_rank(turns, ["conv_id", "turn", "role", "text"])
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    same = ranked.groupBy("role", "text").agg(F.min("_rank").alias("ref"))
    words = F.regexp_count("text", F.lit(WORD_GAP.replace("[", "[^", 1))).cast("long").alias("words")
    placed = ranked.join(same, ["role", "text"]).select("conv_id", "_rank", "ref", words).join(first, "conv_id")
    return cut_lineage(placed.select("conv_id", (F.col("_rank") - F.col("_first")).alias("pos"), "ref", "words"), "turns")


def members(turns: DataFrame, seed: int = 0) -> DataFrame:
    """A row per rebuilt conversation and depth from 0: (conv_id, depth, a, b, pa, pb, ref, words, ends),
    a and b the fingerprint, pa and pb the parent's (null for the root)."""
    t = [f"t{i}" for i in range(BASES)]
    termed = turns.mapInArrow(_terms(seed), "conv_id long, pos long, ref long, words long, " + ", ".join(f"{c} long" for c in t))
    termed = cut_lineage(prefix_sums(termed, "conv_id", "pos", {f"s{i}": c for i, c in enumerate(t)}, PRIME), "prefix-sums")
    # products of the first 0 to 3 turns of every conversation
    first = [F.coalesce(F.sum(F.when(F.col("pos") < k, F.col(t[i]))), F.lit(0)).alias(f"e{k}_{i}") for k in range(HEAD + 1) for i in range(BASES)]
    heads = termed.filter(F.col("pos") < HEAD).groupBy("conv_id").agg(*first)
    length = termed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = cut_lineage(length.join(heads, "conv_id").withColumn("h", head_length(F.col("conv_id"))), "heads")

    def product(frame: str, k: Column, i: int) -> Column:
        return F.element_at(F.array(*[F.col(f"{frame}.e{n}_{i}") for n in range(HEAD + 1)]), k + 1) % PRIME

    base = F.col("c.conv_id") - F.col("c.conv_id") % FAMILY
    taken = F.least(F.col("c.h"), F.coalesce(F.col("b.n"), F.lit(0))).cast("int")
    own = F.greatest(F.col("c.n") - F.col("c.h"), F.lit(0))
    convs = (heads.alias("c").join(heads.alias("b"), base == F.col("b.conv_id"), "left")
             .select(F.col("c.conv_id").alias("conv_id"), base.alias("base"), F.col("c.h").alias("h"), taken.alias("taken"), (taken + own).alias("length"),
                     *[F.coalesce(product("b", taken, i), F.lit(0)).alias(f"head{i}") for i in range(BASES)],
                     *[product("c", F.col("c.h"), i).alias(f"cut{i}") for i in range(BASES)]))
    convs = cut_lineage(convs, "convs")

    def shifted(i: int, x: Column) -> Column:
        """x * B^(taken - h): the place that an own turn has in the rebuilt conversation."""
        inverse = [pow(bases(seed)[i], -k, PRIME) for k in range(HEAD + 1)]
        return x * F.element_at(F.array(*map(F.lit, inverse)), F.col("h") - F.col("taken") + 1) % PRIME

    def row(parts: list[Column], last: list[Column], depth: Column) -> list[Column]:
        before = [F.pmod(x - y, F.lit(PRIME)) for x, y in zip(parts, last)]

        def two(x: list[Column], name: str) -> list[Column]:
            return [(x[0] * (1 << 31) + x[1]).alias(name), (x[2] * (1 << 31) + x[3]).alias(name.replace("a", "b"))]
        p = two(before, "pa")
        return ["conv_id", depth.alias("depth"), *two(parts, "a"), p[0], p[1].alias("pb"), "ref", "words", (depth == F.col("length")).alias("ends")]

    rest = convs.join(termed, "conv_id").filter("pos >= h")
    suffix = [shifted(i, F.pmod(F.col(f"s{i}") - F.col(f"cut{i}"), F.lit(PRIME))) for i in range(BASES)]
    rest = rest.select(*row([(F.col(f"head{i}") + suffix[i]) % PRIME for i in range(BASES)], [shifted(i, F.col(t[i])) for i in range(BASES)],
                            F.col("taken") + F.col("pos") - F.col("h") + 1))
    head = termed.filter(F.col("pos") < HEAD).withColumnRenamed("conv_id", "base")
    head = convs.join(head, "base").filter("pos < taken").select(*row([F.col(f"s{i}") for i in range(BASES)], [F.col(c) for c in t], F.col("pos") + 1))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), none.alias("ref"), zero.alias("words"),
                        (F.col("length") == 0).alias("ends"))
    return rest.unionByName(head).unionByName(root)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) to blocks of at most ``IDS`` ids of a node, comma-joined."""
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in NODE])
        conv = batch["conv_id"].to_numpy()
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)) if len(conv) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        begin = np.flatnonzero(new | ((np.arange(len(conv)) - begin[of]) % IDS == 0)) if len(conv) else begin
        texts = conv.astype(str)
        blocks = [",".join(texts[i:j]) for i, j in zip(begin, np.append(begin[1:], len(conv)))]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[begin]) for k in keys], pa.array(conv[begin]), pa.array(blocks, pa.string())], [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by node and first id to a SHA-256 for each node, block by block."""
    def out(key, state):
        return pa.RecordBatch.from_pydict({**{c: pa.array([x], pa.int64()) for c, x in zip(NODE, key)}, "ends_sha256": [state.hexdigest()]})

    now, state = None, None
    for batch in batches:
        for *key, ids in zip(*[batch[c].to_pylist() for c in NODE], batch["ids"].to_pylist()):
            if key != now:
                if now is not None:
                    yield out(now, state)
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if now is not None:
        yield out(now, state)


def end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of every node's ending members, ascending and comma-joined. The ids are sorted and joined
    in blocks by many tasks; one task hashes a node's blocks in their order, never holding more than a few."""
    order = [*NODE, "conv_id"]
    ends = rows.filter("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ends.mapInArrow(_joined_ids, "depth long, a long, b long, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def conversation_trie(df: DataFrame, tries: int = 8) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and ref, the number of the
    turn that stands for its last one (null for the root).

    ``df`` has conv_id, turn, role and text; other columns are not read. A null turn comes first, rows of
    one turn are ordered by role and text, repeated rows are turns of their own; null roles and texts
    are empty. Rows without conv_id belong to no conversation. A conversation whose base is absent or
    short takes what there is (ids below 0 have the remainder of SQL, so -7 belongs to 0); one without any turn left is a member of the root only. An empty table
    has no conversation and no node."""
    turns = stored_turns(df)
    for seed in range(tries):
        rows = cut_lineage(members(turns, seed), "members")
        one = [F.min(c).eqNullSafe(F.max(c)) for c in ("ref", "pa", "pb")]
        nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("ref").alias("ref"), F.min("pa").alias("pa"),
                                        F.min("pb").alias("pb"), F.max("words").alias("words"), (one[0] & one[1] & one[2]).alias("equal"))
        nodes = cut_lineage(nodes, "nodes")
        if not nodes.filter("not equal").limit(1).count():
            break
    else:
        raise RuntimeError(f"no bases without a collision in {tries} tries")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = cut_lineage(nodes.drop("equal"), "nodes")
    # a node counts for its smallest member: sums from below along that member's path, and whole sums
    path = nodes.groupBy("conv_id").agg(F.sum("saved").alias("path_saved"), F.sum("leaf").alias("path_leaves"))
    above = prefix_sums(nodes, "conv_id", "depth", {"upto": "saved"})
    whole = rows.join(path.filter("path_saved > 0 OR path_leaves > 0"), "conv_id").groupBy(*NODE).agg(F.sum("path_saved").alias("all_saved"), F.sum("path_leaves").alias("n_leaves"))
    out = above.join(path.select("conv_id", "path_saved"), "conv_id").join(whole, NODE).join(end_digests(rows), NODE, "left")
    top = nodes.filter("depth = 0").select("conv_id")
    parents = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("found"))
    parent = F.when(F.col("depth") == 1, top.scalar()).otherwise(F.col("found"))
    below = F.col("path_saved") - F.col("upto") + F.col("saved")  # the member's own from this depth on
    return (out.join(parents, ["depth", "pa", "pb"], "left")
            .select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    (F.col("all_saved") - F.col("path_saved") + below).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "ref"))
