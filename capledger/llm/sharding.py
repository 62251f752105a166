"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.common import running_start

# A tree maps region -> rack -> shard number -> weight.
Tree = dict[str, dict[str, dict[int, float]]]

# 16 shards in two regions of two racks, and the region that holds one more shard.
TREE: Tree = {
    f"region{r}": {f"rack{r}{k}": {8 * r + 4 * k + s: 1.0 for s in range(4)} for k in range(2)} for r in range(2)
}
GROWN: Tree = TREE | {"region2": {"rack20": {16: 1.0}}}


def weight(node: float | dict) -> float:
    """Weight of a subtree: the sum of its shards' weights."""
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def _children(tree: Tree) -> list[list[list[tuple[str, float, int]]]]:
    """Per level, the children (path, weight, number) of each node; numbers count a level's nodes, and
    at the last level are the shards."""
    racks = [(r, k) for r in tree for k in tree[r]]
    regions = [(f"/{r}", weight(tree[r]), i) for i, r in enumerate(tree)]
    of_region = [[(f"/{r}/{k}", weight(tree[r][k]), racks.index((r, k))) for k in tree[r]] for r in tree]
    of_rack = [[(f"/{r}/{k}/{s}", float(w), s) for s, w in tree[r][k].items()] for r, k in racks]
    levels = [[regions], of_region, of_rack]
    live = [[[c for c in node if c[1] > 0] for node in level] for level in levels]
    if not live[0][0]:
        raise ValueError("no shard has a weight")
    return live


def descend(key: Column, tree: Tree) -> Column:
    """Shard of a key: at each level the child with the smallest weighted draw is entered.

    A child's draw is exponential with its weight as rate, decided by 52 bits of the MD5 of its path and
    the key. Where weights change, keys move between the changed subtrees and their siblings and
    nowhere else; a subtree that is added to a node takes keys and gives none. Children with a weight of 0
    get no keys; the first listed wins a tie.
    """

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(child["path"], F.lit(":"), key)), 1, 13), 16, 10).cast("double")
        score = -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / child["weight"]
        return F.struct(score.alias("score"), child["number"].alias("number"))

    node = F.lit(0)
    for level in _children(tree):
        listed = F.array(
            *[
                F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("number")) for p, w, n in children])
                for children in level
            ]
        )
        node = F.array_min(F.transform(F.get(listed, node), draw))["number"]
    return node


def shard(
    docs: DataFrame, tree: Tree = TREE, grown: Tree | None = GROWN, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per input row: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    The id alone decides (law ``key``): rows that repeat an id share a shard, NULL ids share one too.
    ``size`` is the text's UTF-8 bytes plus 1, a NULL text having none. Slots number the rows of a shard
    from 0 in order of id, checksum and size. ``grown_shard`` is the shard in the tree ``grown``, which opens
    another region for the added shard, so that rows move only there. An empty table gives an empty
    result; other columns play no part.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    name = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    rows = rows.withColumns(
        {
            "shard": descend(name, tree).cast("int"),
            "grown_shard": (F.lit(None) if grown is None else descend(name, grown)).cast("int"),
        }
    )
    placed = running_start(rows, ["shard"], ["_id", "text_crc32", "size"], None, "slot")
    return placed.select(
        F.col("_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
