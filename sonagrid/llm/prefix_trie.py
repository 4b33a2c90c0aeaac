"""The prefix trie of conversations: one node for every distinct sequence of first turns.

Numpy scans give every turn the polynomial fingerprint of all turns so far (range-partitioned, so
one conversation may lie in many tasks). Turns of equal depth and fingerprint are candidates for
one node. Each is compared with the turn of its group's representative, role and text, so a
sequence is verified turn by turn along its depths; where one differs, its turn gets another hash
and the scan is done again, until no turn differs.

Sums over subtrees need neither levels nor all ancestors of a node: the trie is cut into heavy
paths (from each node to its child of most members). A node's way to the root crosses at most
log2(members) light edges, so each path sends its total to that many nodes, and one scan up each
path adds up what is below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import scans, storage

#: Ids of one node that are joined in one piece.
PIECE = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _with_print_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = [b.schema.get_field_index(c) for c in ("print", "hash")]
        found, value = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scans.print_before(found, value), pa.int64())], names=[*b.schema.names, "before"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and ``place`` (from 1) by turn, null first; null roles and texts become empty.

    Rows of one turn go by role, then by the SHA-256 of role and text. Rows without a conv_id are left out.
    """
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = given.filter("conv_id IS NOT NULL").withColumn("digest", digest)
    return scans.scan(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], scans.place(), "numbered").select("conv_id", "place", "role", "text")


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: all conv_ids, and their turns (conv_id, own, place, role, text).

    Conversation c begins with the first h turns of c - c % span, where h = crc32(c) % most, and
    goes on with its own turns after its first h. (own, place) orders a conversation's turns.
    """
    rows = numbered_turns(turns)
    share = F.crc32(F.col("conv_id").cast("string")) % most
    every = rows.select("conv_id").distinct()
    wanted = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), share.alias("share"))
    # A base has at most ``most`` - 1 such turns, and ``span`` conversations, so no key is hot.
    lent = rows.filter((F.col("conv_id") % span == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    begun = wanted.join(lent.hint("shuffle_hash"), "base").filter(F.col("place") <= F.col("share"))
    own = rows.filter(F.col("place") > share)
    return every, begun.select("conv_id", F.lit(0).alias("own"), "place", "role", "text").unionByName(own.select("conv_id", F.lit(1).alias("own"), "place", "role", "text"))


def _hash(bits: int, turn: int) -> Column:
    """The hash of a turn; the lowest ``bits`` only, to let tests collide at the first attempt."""
    whole = F.xxhash64(F.lit(turn), "role", "text")
    return whole if bits >= 64 else F.pmod(whole, F.lit(1 << bits))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of ids by node in, one digest a node out; holds one batch."""
    node, sha, out = None, None, []
    for b in batches:
        for depth, found, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (depth, found) != node:
                if node is not None:
                    out.append([*node, sha.hexdigest()])
                node, sha = (depth, found), hashlib.sha256(piece.encode())
            else:
                sha.update(f",{piece}".encode())
    if node is not None:
        out.append([*node, sha.hexdigest()])
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "print", "ends_sha256"])


def _ends(ids: DataFrame, chains: DataFrame) -> DataFrame:
    """depth, print, ends_sha256 of the nodes at which conversations end."""
    last = chains.groupBy("conv_id").agg(F.max(F.struct("depth", "print")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("last.depth", F.lit(0)).alias("depth"), F.coalesce("last.print", F.lit(0)).alias("print"), "conv_id")
    # A piece has at most PIECE ids, however many conversations end at a node.
    pieces = ends.groupBy("depth", "print", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("depth", "print").sortWithinPartitions("depth", "print", "piece")
    return dealt.mapInArrow(_joined_ids, "depth long, print long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame, order: list[str], bits: int = 64) -> DataFrame:
    """The nodes of the trie of (role, text) sequences, the root first in depth.

    ``ids`` has the conv_id of every conversation, those without turns too; ``turns`` has conv_id,
    role, text and the columns of ``order``. Returns, a row a node: conv_id (its smallest member),
    depth, parent_conv_id (the parent's conv_id; null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over its subtree: members less one,
    times the code points of a node's last text) and ends_sha256 (of the ids that end there,
    ascending, comma-joined). Roles and texts must not be null; rows equal in ``order`` are taken
    in any order. No conversation at all: no node. Other columns are not read.
    """
    places = [f"_order{i}" for i in range(len(order))]
    by = [F.col(c) for c in places]
    ids = storage.written(ids.select("conv_id").distinct(), "ids")
    rows = turns.select("conv_id", *(F.col(c).alias(p) for c, p in zip(order, places, strict=True)), "role", "text", _hash(bits, 0).alias("hash"))
    attempt = 0
    while True:
        scanned = scans.scan(rows, ["conv_id"], by, scans.prefix_fingerprints("hash"), "prefixes").drop(scans.CHANCE)
        kind = T.StructType([*scanned.schema.fields, T.StructField("before", T.LongType())])
        chains = scanned.mapInArrow(_with_print_before, kind).withColumnRenamed("place", "depth")
        nodes, steps = _candidates(ids, chains)
        wrong = steps.filter("differs").select("conv_id", "depth")
        if not wrong.limit(1).count():
            return _rolled_up(nodes, steps, _ends(ids, chains))
        attempt += 1
        again = chains.join(wrong.withColumn("again", F.lit(True)), ["conv_id", "depth"], "left")
        rows = again.select("conv_id", *places, "role", "text", F.when(F.col("again"), _hash(64, attempt)).otherwise(F.col("hash")).alias("hash"))


def _candidates(ids: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by (depth, print), and every turn with its node: whether it differs from the node's first member's."""
    first = F.min(F.struct("conv_id", "role", "text")).alias("first")
    groups = chains.groupBy("depth", "print").agg(first, F.count("*").alias("n_convs"), F.min("before").alias("before"))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.struct(F.min("conv_id").alias("conv_id"), F.lit("").alias("role"), F.lit("").alias("text")).alias("first"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = storage.written(groups.unionByName(root.select(zero.alias("depth"), zero.alias("print"), "first", "n_convs", F.lit(None).cast("long").alias("before"))), "groups")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("print"))
    heaviest = below.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("first.conv_id"), "print")).alias("heavy"))
    full = storage.written(nodes.join(heaviest, ["depth", "print"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "heavy": F.col("heavy.print")}), "nodes")
    # The children of one node, and the members of another, may be a third of all rows: both joins
    # are of shuffled tables, which adaptive execution splits by skewed keys.
    above = full.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), F.col("first.conv_id").alias("parent_conv_id"), F.col("heavy").alias("wanted"))
    child = full.filter("depth > 0").hint("merge").join(above, ["depth", "before"])
    child = storage.written(child.select("depth", "print", "before", "first", "n_convs", "n_children", "parent_conv_id", (F.col("print") != F.col("wanted")).alias("light")), "children")
    differs = (F.col("first.role") != F.col("role")) | (F.col("first.text") != F.col("text"))
    known = child.select("depth", "print", "first", "light", "n_convs", "n_children", "parent_conv_id")
    own = F.col("first.conv_id") == F.col("conv_id")
    steps = chains.select("conv_id", "depth", "print", "before", "role", "text").hint("merge").join(known, ["depth", "print"])
    value = (F.col("n_convs") - 1) * F.length("text")
    kept = steps.select("conv_id", "depth", "print", "before", "light", own.alias("own"), differs.alias("differs"), *(F.when(own, F.col(c)).alias(c) for c in ("n_convs", "n_children", "parent_conv_id")), F.when(own, value.cast("long")).alias("saved"))
    return full, storage.written(kept, "steps")


def _rolled_up(nodes: DataFrame, steps: DataFrame, ends: DataFrame) -> DataFrame:
    found = scans.scan(steps, ["conv_id"], [F.col("depth")], scans.last_marked("light", "depth", "print"), "paths")
    path = {"path_depth": F.col("last_depth"), "path_print": F.col("last_print")}  # of the root's path: 0, 0
    zero = F.lit(0).cast("long")
    columns = ["depth", "print", "conv_id", "parent_conv_id", "n_convs", "n_children"]
    owned = found.filter("own").select(*columns, "saved", *(v.alias(k) for k, v in path.items()))
    root = nodes.filter("depth = 0").select("depth", "print", F.col("first.conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", *(zero.alias(c) for c in ("saved", *path)))
    own = storage.written(owned.unionByName(root).withColumn("leaves", (F.col("n_children") == 0).cast("long")), "owned")
    totals = own.groupBy(*path).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    # Where each path hangs, and the path that it hangs on, and so on up: the light turns of its head's first member.
    heads = found.filter("own AND light").select("conv_id", F.col("depth").alias("path_depth"), F.col("print").alias("path_print"))
    hangs = found.filter("light").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("before").alias("print"))
    onto = heads.join(hangs, "conv_id").filter(F.col("depth") < F.col("path_depth"))
    sent = onto.join(totals, list(path)).groupBy("depth", "print").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    given = own.join(sent, ["depth", "print"], "left")
    given = given.select(*columns, *path, *((F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in ("saved", "leaves")))
    summed = scans.scan(given, list(path), [F.col("depth").desc()], scans.sums("saved", "leaves"), "summed")
    out = summed.join(ends, ["depth", "print"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
