"""Prefix trie of conversations by fixed-length block hashing.

Turns are numbered and cut into blocks of a few turns. A block's digest combines the digests
of its turns and their places; the digests of the blocks before it name the prefix that
leads to it. Conversations are grouped block by block: those that reach a block by the
same prefix form a group. Where all of a group agree on the block, its turns are a chain of nodes
with the same members, and one row stands for all of them. Only where siblings
diverge inside the block are its turns opened, and grouped turn by turn.

Sums over subtrees need no walk through the levels. A node belongs to its smallest member,
and that member's path meets all the node's ancestors, so a subtree's sum is the sum, over the
members of its top, of what each of them owns from that depth on: suffix sums in each
conversation, then one aggregation, again by blocks where a group agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import salted_join, table
from tallycast.storage import materialise

BLOCK = 4  # turns


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, bytes): the digest of each turn's role and text, numbered from 1.

    Turns are ordered by turn, null first; turns of equal number by role, then by digest. Null roles
    and texts are empty, rows of a null conv_id are left out. Only digests are shuffled. A conversation is
    numbered in one task, which sorts its digests and spills.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        F.col("turn").alias("at"),
        role.alias("role"),
        F.md5(F.concat(role, F.lit("\x00"), text, F.lit("\x00"), F.length(role))).alias("turn"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "turn")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", "turn", "bytes")


def _placed(turns: DataFrame) -> DataFrame:
    """Digests that hold the place too: the exclusive or of the first d of them names a sequence of d turns."""
    digest = F.md5(F.concat_ws(":", "pos", "turn"))
    half = "CAST(conv(substring(digest, {}, 15), 16, 10) AS BIGINT)"  # 60 bits each
    return turns.withColumn("digest", digest).select(
        "conv_id", "pos", F.expr(half.format(1)).alias("x"), F.expr(half.format(17)).alias("y"), "bytes"
    )


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and their rebuilt turns (conv_id, pos, x, y, bytes).

    Conversation c is the first h turns of conversation c - c % ``family`` (all if fewer, none if absent),
    then its own turns after its first h, where h is the CRC-32 of c modulo ``most``.
    """
    kept = materialise(numbered(conversations), "turns")
    ids = materialise(kept.groupBy("conv_id").agg(F.max("pos").alias("own")), "conversations")
    h = F.expr(f"crc32(CAST(conv_id AS STRING)) % {most}")
    wanted = ids.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base"))
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    wanted = wanted.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_turns", F.lit(0))))
    # A base serves the few conversations of its family, each with fewer than ``most`` turns.
    heads = kept.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    first = heads.join(wanted.select("base", "conv_id", "h"), "base").where("pos <= h").select("conv_id", "pos", "turn", "bytes")
    later = kept.where(F.col("pos") > F.expr(f"crc32(CAST(conv_id AS STRING)) % {most}"))
    later = salted_join(later, wanted.select("conv_id", "h", "k", "own"), ["conv_id"], "own", "pos").select("conv_id", F.expr("pos - h + k").alias("pos"), "turn", "bytes")
    return ids.select("conv_id"), _placed(first.unionByName(later))


def _sha256_of_ids(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256) of the comma-joined conv_ids of each key, in ascending order.

    A digest is sequential, so the ids of a key stream through one task, in bounded memory.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(ends.dtypes)
    ordered = ends.repartition(parts, *keys).sortWithinPartitions(*keys, "conv_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            named = list(zip(*(batch[k].tolist() for k in keys)))
            for key, conv_id in zip(named, batch["conv_id"].tolist()):
                if key != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(str(conv_id).encode())
                else:
                    sha.update(f",{conv_id}".encode())
            if out:
                yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if sha:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*keys, "ends_sha256"])

    return ordered.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ends_sha256 string")


def _xor_to(items: str, upto: str, field: str, start: str) -> str:
    return f"aggregate(slice({items}, 1, {upto}), {start}, (a, i) -> a ^ i.{field})"


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, k, p, q, b, c, items): each conversation's blocks of ``size`` turns, the prefix (p, q) that
    leads to block k, the block's digest (b, c) and its turns (pos, x, y, bytes) in order."""
    cut = turns.withColumn("k", F.expr(f"CAST((pos - 1) DIV {size} AS BIGINT)"))
    grouped = cut.groupBy("conv_id", "k").agg(
        F.expr("bit_xor(x)").alias("b"),
        F.expr("bit_xor(y)").alias("c"),
        F.array_sort(F.collect_list(F.struct("pos", "x", "y", "bytes"))).alias("items"),  # ``size`` at most
    )
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    prefix = [F.coalesce(F.expr(f"bit_xor({d})").over(before), F.lit(0).cast("long")).alias(n) for d, n in (("b", "p"), ("c", "q"))]
    return grouped.select("conv_id", "k", *prefix, "b", "c", "items")


def trie(ids: DataFrame, turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``ids`` has every conv_id once, those without turns too; ``turns`` is (conv_id, pos, x, y, bytes), see
    ``rebuilt``. Without any conversation there is no node.
    """
    rows = materialise(blocks(turns, size), "turn-blocks")
    groups = rows.groupBy("k", "p", "q").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        F.min(F.struct("b", "c")).alias("low"),
        F.max(F.struct("b", "c")).alias("high"),
    )
    groups = materialise(groups.select("k", "p", "q", "n", "least", (F.col("low") == F.col("high")).alias("agreed")), "block-groups")
    split = groups.where("NOT agreed").select("k", "p", "q", "n")

    # Chains: the smallest member's block stands for the group.
    same = groups.where("agreed")
    agreed = rows.join(same.select(F.col("least").alias("conv_id"), "k", "n"), ["conv_id", "k"])
    chains = agreed.select("conv_id", "k", "p", "q", "n", "items", F.posexplode("items").alias("i", "item"))
    # Opened blocks: one row per member and turn.
    members = salted_join(rows, split, ["k", "p", "q"], "n", "conv_id", "left_semi")
    opened = materialise(members.select("conv_id", "k", "p", "q", "items", F.posexplode("items").alias("i", "item")), "opened-turns")
    keyed = [
        F.col("item.pos").alias("depth"),
        *[F.expr(_xor_to("items", "i + 1", f, s)).alias(n) for f, s, n in (("x", "p", "kx"), ("y", "q", "ky"))],
        *[F.expr(_xor_to("items", "i", f, s)).alias(n) for f, s, n in (("x", "p", "px"), ("y", "q", "py"))],
        F.col("item.bytes").alias("bytes"),
    ]
    at_turn = opened.select("conv_id", "k", *keyed)
    branched = at_turn.groupBy("depth", "kx", "ky").agg(
        F.min("conv_id").alias("conv_id"), F.first("px").alias("px"), F.first("py").alias("py"),
        F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
    )
    whole = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.selectExpr("conv_id", "0L AS depth", "0L AS kx", "0L AS ky", "CAST(NULL AS BIGINT) AS px", "CAST(NULL AS BIGINT) AS py", "n_convs", "0L AS bytes", "false AS agreed")
    chained = chains.select("conv_id", *keyed, F.col("n").alias("n_convs"), F.lit(True).alias("agreed"))
    nodes = chained.unionByName(branched.withColumn("agreed", F.lit(False))).unionByName(root)
    nodes = materialise(nodes, "trie-nodes")

    children = nodes.where("depth > 0").groupBy("px", "py", "depth").agg(F.count("*").alias("n_children"))
    children = children.selectExpr("px AS kx", "py AS ky", "depth - 1 AS depth", "n_children")
    nodes = nodes.join(children, ["depth", "kx", "ky"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialise(
        nodes.withColumns({"saved": F.expr("(n_convs - 1) * bytes"), "leaf": F.expr("IF(n_children = 0, 1L, 0L)"), "k": F.expr(f"IF(depth = 0, -1L, (depth - 1) DIV {size})")}),
        "valued-nodes",
    )

    # What each conversation owns after each of its blocks.
    owned = nodes.groupBy("conv_id", "k").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    member = rows.select("conv_id", "k", "p", "q").join(owned, ["conv_id", "k"], "left")
    zero = F.lit(0).cast("long")
    member = member.withColumns({f"{c}_after": F.coalesce(F.sum(c).over(after), zero) for c in ("saved", "leaf")}).drop("saved", "leaf")
    member = materialise(member, "owned-after")

    # Chains: the group's sum beyond the block, and the rest of the chain.
    beyond = member.groupBy("k", "p", "q").agg(F.sum("saved_after").alias("saved_after"), F.sum("leaf_after").alias("leaf_after"))
    beyond = same.join(beyond, ["k", "p", "q"]).select(F.col("least").alias("conv_id"), "k", "saved_after", "leaf_after")
    rest = Window.partitionBy("conv_id", "k").orderBy(F.desc("depth"))
    chain_sums = nodes.where("agreed").join(beyond, ["conv_id", "k"]).select(
        "depth", "kx", "ky", *[(F.col(f"{c}_after") + F.sum(c).over(rest)).alias(f"{c}_sum") for c in ("saved", "leaf")]
    )
    # Opened blocks: what each member owns from a turn on, within the block and beyond it.
    mine = nodes.where("NOT agreed AND depth > 0").select("conv_id", "depth", "saved", "leaf")
    per_turn = at_turn.select("conv_id", "k", "depth", "kx", "ky").join(mine, ["conv_id", "depth"], "left")
    per_turn = per_turn.withColumns({c: F.coalesce(F.sum(c).over(rest), zero) for c in ("saved", "leaf")})
    per_turn = per_turn.join(member.select("conv_id", "k", "saved_after", "leaf_after"), ["conv_id", "k"])
    open_sums = per_turn.groupBy("depth", "kx", "ky").agg(
        *[F.sum(F.col(c) + F.col(f"{c}_after")).alias(f"{c}_sum") for c in ("saved", "leaf")]
    )
    root_sums = nodes.agg(F.sum("saved").alias("saved_sum"), F.sum("leaf").alias("leaf_sum")).where("leaf_sum IS NOT NULL")
    root_sums = root_sums.selectExpr("0L AS depth", "0L AS kx", "0L AS ky", "saved_sum", "leaf_sum")
    sums = chain_sums.unionByName(open_sums).unionByName(root_sums)

    # Conversations by the node they end at.
    paths = rows.groupBy("conv_id").agg(
        F.sum(F.size("items")).cast("long").alias("depth"), F.expr("bit_xor(b)").alias("kx"), F.expr("bit_xor(c)").alias("ky")
    )
    ends = ids.join(paths, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("depth", "kx", "ky")])
    ended = _sha256_of_ids(ends, ["depth", "kx", "ky"])

    done = nodes.join(sums, ["depth", "kx", "ky"]).join(ended, ["depth", "kx", "ky"], "left")
    # A node's parent is found by the parent's key; below one parent may stand a third of all nodes.
    parents = nodes.where("n_children > 0").selectExpr("depth + 1 AS depth", "kx AS px", "ky AS py", "conv_id AS parent_conv_id", "n_children")
    return salted_join(done, parents, ["depth", "px", "py"], "n_children", "kx", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaf_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13(spark, folder: str) -> DataFrame:
    ids, turns = rebuilt(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(ids, turns)
