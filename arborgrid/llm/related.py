"""Problem 3: splits of given proportions that keep related records together.

1. Keys: every record gives up to one key a field (normalised; none where missing or a stand-in).
2. Edges: the members of a key are tied to its smallest id by a star of two levels, over salted
   parts of at most about PART_ROWS records, so a key that a third of all records share makes no
   hot vertex. Keys of less than 1/2000 of all rows stay whole.
3. Boruvka rounds: each component takes its smallest incident edge, the chosen edges are added to
   the forest, chosen trees are contracted by pointer jumping, edges are relabelled and repeated
   ones merged. A component's name is its smallest id. Each round at least halves the components
   that still have edges; rounds are written to the shared folder, which cuts the lineage.
   Components that many edges or ids point to meet them by plans.lookup.
4. Deal: components of at least 1/200 of all records (at most 200) are given, largest first, to
   the split that lacks most. The others are dealt by size band (powers of two) in hash order:
   the r-th card of a band goes where r times the golden ratio falls among the shares still open.

Defined cases: records without id are left out; repeats of an id count as one record, with the
keys of all its rows and the label of the latest; nulls in fields give no key; an empty table
gives no rows; equal shares keep the order of the targets' names; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.plans import Scratch, grouped_rank, lookup, skew

PART_ROWS, BIG_KEYS = 10_000, 2_000
BIG_SHARE = 200


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, and those letters."""
    frm, to = [], []
    for c in range(0xC0, min(0x2C00, sys.maxunicode)):
        base = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha():
            frm.append(chr(c))
            to.append(base[0])
    return "".join(frm), "".join(to)


def plain(text: Column) -> Column:
    """Lower case without accents."""
    frm, to = _accents()
    return F.lower(F.regexp_replace(F.translate(text, frm, to), r"\p{M}+", ""))


def _number(text: Column) -> Column:
    return F.when(text != "", F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0")))


def author_key(c: Column) -> Column:
    """Three words in any order; null for anything else."""
    words = F.filter(F.split(plain(c), r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(words) == 3, F.array_join(F.array_sort(words), " "))


def source_key(c: Column) -> Column:
    """Rig number and series number, in either order."""
    rig, series = (_number(F.regexp_extract(F.lower(c), rf"{w}[^0-9]*([0-9]+)", 1)) for w in ("rig", "series"))
    return F.when(rig.isNotNull() & series.isNotNull(), F.concat_ws("/", rig, series))


def entity_key(c: Column) -> Column:
    """The number, if there is exactly one."""
    numbers = F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    return F.when(F.size(numbers) == 1, _number(F.get(numbers, F.lit(0))))


KEYS = {"author": author_key, "source": source_key, "entity": entity_key}


def star_edges(df: DataFrame, id_col: str, keys: Mapping[str, Column], scratch: Scratch, part_rows: int = PART_ROWS) -> DataFrame:
    """(u, v) with u < v that tie the ids of each key together; an edge may come several times."""
    pairs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*[F.concat(F.lit(f"{n}:"), k) for n, k in keys.items()])).alias("key"))
    pairs = scratch.put(pairs.where(F.col("key").isNotNull()))
    # keys that are to be cut, BIG_KEYS at most
    big = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2 * part_rows, -(-pairs.count() // BIG_KEYS)))
    salts = {r["key"]: -(-r["n"] // part_rows) for r in big.collect()}
    cut = F.col("key").isin(list(salts))
    head = F.min("id").over(Window.partitionBy("key"))
    stars = (pairs.where(~cut) if salts else pairs).select(head.alias("u"), F.col("id").alias("v")).where("u < v")
    if not salts:
        return stars
    table = F.broadcast(df.sparkSession.createDataFrame(list(salts.items()), "key string, salts long"))
    hot = pairs.where(cut).join(table, "key").select("id", "key", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    parts = scratch.put(hot.groupBy("key", "salt").agg(F.min("id").alias("part_min")))
    heads = parts.groupBy("key").agg(F.min("part_min").alias("head"))
    inner = hot.join(parts, ["key", "salt"]).select(F.col("part_min").alias("u"), F.col("id").alias("v"))
    outer = parts.join(heads, "key").select(F.col("head").alias("u"), F.col("part_min").alias("v"))
    return stars.unionByName(inner.unionByName(outer).where("u < v"))


def spanning_forest(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, root) of every id that has an edge, root the component's smallest id; and the forest's edges (a, b)."""
    now = scratch.put(edges.select("u", "v", F.struct(F.col("u").alias("a"), F.col("v").alias("b")).alias("e")))
    rounds: list[DataFrame] = []
    forest: list[DataFrame] = []
    while not now.isEmpty():
        both = now.select("u", F.struct(F.col("u").alias("x"), F.col("v").alias("y")).alias("w"), F.col("v").alias("to"), "e").unionByName(
            now.select(F.col("v").alias("u"), F.struct(F.col("u").alias("x"), F.col("v").alias("y")).alias("w"), F.col("u").alias("to"), "e")
        )
        best = scratch.put(both.groupBy("u").agg(F.min(F.struct("w", "to", "e")).alias("m")).select("u", "m.to", "m.e"))
        forest.append(best.select("e.*").distinct())
        # the smallest id of a tree chose the same edge as its peer: it is the root
        back = best.select(F.col("u").alias("to"), F.col("to").alias("back"))
        up = scratch.put(lookup(best, back, "to").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("root")))
        while True:
            above = up.select(F.col("u").alias("root"), F.col("root").alias("top"))
            nxt = scratch.put(lookup(up, above, "root").select("u", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            scratch.drop(up)
            up = nxt
            if not moved:
                break
        up = up.select("u", "root")
        rounds.append(up)
        ends = up.withColumnRenamed("root", "ru")
        n = now.count()
        half = lookup(now, ends, "u", total=n).select("ru", "v", "e")
        half = scratch.put(half) if n > skew.TASK_ROWS else half
        left = lookup(half, up.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v", total=n)
        left = left.where("ru <> rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e"))
        nxt = scratch.put(left)
        scratch.drop(now)
        now = nxt
    spark = scratch.spark
    if not rounds:
        return spark.createDataFrame([], "id long, root long"), spark.createDataFrame([], "a long, b long")
    roots = rounds[-1]
    for r in reversed(rounds[:-1]):
        later = roots.select(F.col("u").alias("root"), F.col("root").alias("top"))
        roots = lookup(r, later, "root", "left").select("u", F.coalesce("top", "root").alias("root"))
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.unionByName(f)
    return scratch.put(roots.select(F.col("u").alias("id"), "root")), scratch.put(tree)


def _deal(sizes: DataFrame, total: int, targets: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(root, split) of the few big components and of the many others."""
    spark = sizes.sparkSession
    names = sorted(targets)
    goal = sum(targets.values()) or 1.0
    wanted = {n: targets[n] / goal * total for n in names}
    limit = max(2, -(-total // BIG_SHARE))
    big = sorted(((r["size"], r["root"]) for r in sizes.where(F.col("size") >= limit).collect()), key=lambda r: (-r[0], r[1]))  # at most BIG_SHARE rows
    dealt = []
    for size, root in big:
        n = max(names, key=lambda n: wanted[n])
        wanted[n] -= size
        dealt.append((root, n))
    left = {n: max(w, 0.0) for n, w in wanted.items()}
    open_ = sum(left.values()) or 1.0
    bands = sizes.where(F.col("size") < limit).withColumn("band", F.floor(F.log2("size")).cast("int"))
    ranked = grouped_rank(bands, ["band"], F.shiftrightunsigned(F.xxhash64("root"), 1), ["root"], "card")
    golden = (5**0.5 - 1) / 2
    spot = (F.col("card") * golden + F.col("band") * 0.381) % 1.0
    split, edge = F.lit(names[-1]), 1.0
    for n in reversed(names[:-1]):
        edge = sum(left[m] for m in names[: names.index(n) + 1]) / open_
        split = F.when(spot < edge, F.lit(n)).otherwise(split)
    few = spark.createDataFrame(dealt, "root long, split string")
    return few, ranked.select("root", split.alias("split"))


def related_split(df: DataFrame, id_col: str, label_col: str, time_col: str, keys: Mapping[str, Column], targets: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """One row per id (id, label, root, size, split), and the spanning forest's edges (a, b)."""
    scratch = Scratch(df.sparkSession, "related")
    roots, forest = spanning_forest(star_edges(df, id_col, keys, scratch), scratch)
    when = F.coalesce(F.col(time_col), F.lit("1970-01-01").cast("timestamp"))
    records = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max_by(label_col, when).alias("label"))
    named = scratch.put(records.join(roots, "id", "left").select("id", "label", F.coalesce("root", "id").alias("root")))
    sizes = scratch.put(named.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    few, many = _deal(sizes, named.count(), targets)
    # big components meet their members by a broadcast of at most BIG_SHARE rows, so no join is hot
    few_sized = F.broadcast(few.join(sizes, "root"))
    rest = named.join(F.broadcast(few.select("root")), "root", "left_anti")
    placed = named.join(few_sized, "root").unionByName(rest.join(many.join(sizes, "root"), "root"), allowMissingColumns=True)
    return placed.select("id", "label", "root", "size", "split"), forest
