"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards; a node weighs as much as the shards below it. A row descends from the root: at each
level every child draws -ln(u) / weight, with u a hash of the row's key and the child's name, and the smallest draw wins.
A child is thus chosen with a probability proportional to its weight, and what a change of a weight moves is confined:
a draw depends on its own child only, so rows leave or enter the subtree whose weight changed and no other.

A tree grows by a shard in a region and rack of its own (`grown`). No other node's weight changes then, so all rows that
move go into the new shard, at any number of shards. Adding a shard to an existing rack (`Tree.with_weight`) moves rows
into that region only, but deals some of them anew within the region.

Places within a shard follow a hash of key and text checksum, a shuffled order that does not depend on the layout of the
input. They are worked out in two passes: cells of bounded size are ranges of that hash, a table of counts per shard and
cell gives each cell's first place, and rows are ordered within their cell only. Equal rows are counted before the
shuffle and dealt out again behind it, so neither a hot key nor copies gather in a task.

Defined cases: a null key is a key of its own; null text has no bytes and checksum 0; repeated rows lie in one shard at
places of their own; equal texts of different keys are placed apart, by their keys; an empty table gives no rows; other columns are carried by
`place` and `write_shards`, unless they bear a name that is added, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Hex digits of a hash that become a number; the same number of bits fits a double exactly in twelve of them.
DRAW_DIGITS, ORDER_DIGITS = 12, 15
CELL_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """shards: (region, rack, shard, weight) of each."""

    shards: tuple[tuple[int, int, int, float], ...]

    def children(self, region: int | None = None, rack: int | None = None) -> dict[int, float]:
        """Children of the root, of a region or of a rack, with the weights below them."""
        depth = (region is not None) + (rack is not None)
        weights: dict[int, float] = {}
        for s in self.shards:
            if (region is None or s[0] == region) and (rack is None or s[1] == rack):
                weights[s[depth]] = weights.get(s[depth], 0.0) + s[3]
        return {k: w for k, w in sorted(weights.items()) if w > 0}

    def with_weight(self, region: int, rack: int, shard: int, weight: float) -> Tree:
        """A shard's weight set, or a shard added; 0 takes it out."""
        rest = [s for s in self.shards if s[2] != shard]
        return Tree((*rest, (region, rack, shard, weight)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own: it alone takes rows."""
        return self.with_weight(max(s[0] for s in self.shards) + 1, 0, max(s[2] for s in self.shards) + 1, weight)


def even_tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
    """So many racks in each region and shards in each rack, all of weight 1."""
    return Tree(tuple((g, r, (g * racks + r) * shards + s, 1.0) for g in range(regions) for r in range(racks) for s in range(shards)))


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _winner(key: Column, path: str, children: dict[int, float]) -> Column:
    """The child with the smallest weighted draw; of equal draws the first."""
    draw = lambda child, weight: -F.log((_number(F.concat(key, F.lit(f"/{path}{child}")), DRAW_DIGITS) + 1) / float(16**DRAW_DIGITS + 1)) / weight
    drawn = [F.struct(draw(c, w).alias("draw"), F.lit(c).alias("child")) for c, w in children.items()]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["child"]


def _key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def place(docs: DataFrame, tree: Tree, key: str = "doc_id", names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """docs with region, rack and shard of each row: a projection, no shuffle. Only draws on a row's way down are made."""
    text, regions = _key_text(key), tree.children()
    region, rack, shard = names
    told = docs.withColumn(region, _winner(text, "", regions))
    told = told.withColumn(rack, F.coalesce(*[F.when(F.col(region) == g, _winner(text, f"{g}.", tree.children(g))) for g in regions]))
    ways = [(g, r) for g in regions for r in tree.children(g)]
    return told.withColumn(shard, F.coalesce(*[F.when((F.col(region) == g) & (F.col(rack) == r), _winner(text, f"{g}.{r}.", tree.children(g, r))) for g, r in ways]))


def slots(rows: DataFrame, key: str = "doc_id", check: str = "text_crc32", shard: str = "shard", cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with slot, gapless from 0 in each shard, by a hash of key and check; rows should hold little besides these."""
    names = [c for c in rows.columns if c != "slot"]
    rows = rows.select(*names).withColumn("_order", _number(F.concat(_key_text(key), F.lit(":"), F.coalesce(F.col(check).cast("string"), F.lit(""))), ORDER_DIGITS))
    # copies are counted by part of the input, so that no count is larger than a part
    counted = materialize(rows.withColumn("_part", F.spark_partition_id()).groupBy(*names, "_order", "_part").agg(F.count("*").alias("_copies")), "counted_rows")
    totals = counted.groupBy(shard).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    width = max(1, 16**ORDER_DIGITS // max(1, -(-totals // cell_rows)))
    counted = counted.withColumn("_cell", F.expr(f"_order div {width}"))
    cells = counted.groupBy(shard, "_cell").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col(shard).alias("_shard"), F.col("_cell").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_cell").orderBy("_order", *names, "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(cells, (F.col(shard) == F.col("_shard")) & (F.col("_cell") == F.col("_of")))
    placed = placed.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    spread = placed.select(*names, "_start", "_copies", "_part", "_cell").repartition(shard, "_cell", "_part")  # a hot row's parts leave its task
    return spread.select(*names, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_copies") - 1)).alias("slot"))


def write_shards(docs: DataFrame, path: str, tree: Tree, key: str = "doc_id") -> None:
    """Whole rows as Parquet below path/region=/rack=/shard=; files have the engine's advisory size, hot shards have several."""
    placed = place(docs, tree, key)
    placed.hint("rebalance", "shard").write.partitionBy("region", "rack", "shard").parquet(path)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, its place there, and its shard once there are 25."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    tree = even_tree()
    told = place(place(rows, tree), tree.grown(), names=("_region", "_rack", "grown_shard")).drop("_region", "_rack")
    told = slots(told)
    return told.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
