"""Problem 1: missing values filled from similar records by label propagation.

The graph ties each cell to hubs: one hub for each group or kind of likeness that the cell belongs
to (its line, its trial, its month, its marker among lines of one subpopulation, its marker among
lines with the same neighbouring alleles, ...). A hub stands for all edges between its members, so a
group of n cells costs n edges and never n * n pairs. In the fixpoint

* a hub averages its members: numbers, or distributions over categories; observed members are
  clamped, so their sums are aggregated once; missing members count with their estimate;
* a missing cell averages its hubs, weighted by kind and by how many members speak: n / (n + 2).

``propagate`` is the general operator on cells and hubs. A round solves the first hub of each cell
(the strongest, and the one with the fewest observed members) together with its missing members in
closed form, for the values that the other hubs have in that round; so the rounds left are few.
They end when no estimate moves by more than the tolerance, and raise if that doesn't come about.

``fill_calls`` uses the quotient form: cells that share all hubs have equal estimates, so they are
merged into one profile with counts, and a marker's profiles (bounded by the numbers of categories,
not by rows) converge in one task, some thousand profiles of whole markers at a time. Cells with
calls of their own line and marker are profiles by those counts, so that hub is part of the
fixpoint too.

Defined cases: a cell without any hub that knows a value gets the caller's fallback and is named so;
null groups give no hub; equal shares go to the first category; an empty table gives no fills.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.plans import Scratch, bounded_broadcast, lookup

HALF = 2.0
ROUNDS, TOLERANCE = 100, 1e-3
#: Lines whose subpopulation is broadcast to the calls; beyond that the join shuffles.
BROADCAST_LINES = 1_000_000
#: Hubs (a name, a count and the width's numbers each) that are broadcast to the cells; beyond that joins shuffle.
BROADCAST_HUBS = 100_000
ALLELES = 4


def propagate(
    observed: DataFrame, missing: DataFrame, width: int, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE, scale: str | None = None, prior: str | None = None, prior_weight: float = 1.0
) -> DataFrame:
    """(cell, v0 .. v{width-1}) of the missing cells that some hub reaches.

    ``observed`` has v0 .. v{width-1} and hubs (array<struct<hub string, w double>>, nulls are no
    hubs), ``missing`` has cell and hubs; ``scale`` names a column of ``missing`` that divides moves
    before they are held against the tolerance, ``prior`` an array column of a value that a cell
    knows from elsewhere (null: none), with ``prior_weight``. Weights are those of the missing
    cell's side. No convergence after ``rounds`` raises RuntimeError.
    """
    v = [f"v{i}" for i in range(width)]
    sums = lambda: [F.sum(c).alias(c) for c in [*v, "n"]]
    named = lambda df: df.where("h.hub IS NOT NULL").select(F.col("h.hub").alias("hub"), *v, F.lit(1.0).alias("n"))
    known = scratch.put(named(observed.select(*v, F.explode("hubs").alias("h"))).groupBy("hub").agg(*sums()))
    first = F.get("hubs", F.lit(0))
    cells = missing.select("cell", (F.col(scale) if scale else F.lit(1.0)).alias("unit"), "hubs", first["hub"].alias("hub"), first["w"].alias("w"), (F.col(prior) if prior else F.lit(None).cast("array<double>")).alias("prior"))
    cells = scratch.put(cells)
    total = cells.count()
    others = scratch.put(cells.select(F.explode(F.slice("hubs", 2, 1000)).alias("h")).where("h.hub IS NOT NULL").select(F.col("h.hub").alias("hub")).distinct())
    few = others.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    positions = cells.agg(F.max(F.size("hubs"))).first()[0] or 0
    known_others = scratch.put(known.join(others, "hub", "left_semi"))
    # of the first hub: what is observed, and the number of missing members
    members = cells.where("hub IS NOT NULL").groupBy("hub").agg(F.count(F.lit(1)).cast("double").alias("m0"))
    base = members.join(known.select("hub", *[F.col(c).alias(f"k_{c}") for c in [*v, "n"]]), "hub", "left")
    state = lookup(cells, base, "hub", "left", total=total).withColumns({"m0": F.coalesce("m0", F.lit(0.0)), **{f"k_{c}": F.coalesce(f"k_{c}", F.lit(0.0)) for c in [*v, "n"]}, **{c: F.lit(None).cast("double") for c in v}})
    state = scratch.put(state)
    mixed = not others.join(members, "hub", "left_semi").isEmpty()  # a hub is the first of one cell and a later one of another

    def averages(which: Column, state: DataFrame) -> DataFrame:
        guessed = named(state.where(F.col("v0").isNotNull()).select(*v, F.explode(which).alias("h")))
        guessed = guessed.join(F.broadcast(others) if few else others, "hub", "left_semi") if mixed else guessed
        hubs = known_others.unionByName(guessed).groupBy("hub").agg(*sums())
        return F.broadcast(hubs) if few else scratch.put(hubs)

    for _ in range(rounds):
        later = averages(F.slice("hubs", 2, 1000), state)
        every = averages(F.col("hubs"), state) if mixed else later
        t = state.withColumn("_rest", F.when(F.col("prior").isNotNull(), F.lit(prior_weight)).otherwise(0.0))
        t = t.withColumns({f"_{c}": F.coalesce(F.get("prior", F.lit(i)), F.lit(0.0)) * F.col("_rest") for i, c in enumerate(v)})
        for p in range(0 if mixed else 1, positions):
            side = (every if p else later).select(F.col("hub").alias("_hub"), F.col("n").alias("_n"), *[F.col(c).alias(f"_s_{c}") for c in v])
            t = t.withColumn("_hub", F.get("hubs", F.lit(p))["hub"])
            t = t.join(side, "_hub", "left") if few else lookup(t, side, "_hub", "left", total=total)
            if p == 0:  # a first hub that is another cell's later one: what that one's members say
                t = t.withColumns({f"k_{c}": F.coalesce(F.col(f"_s_{c}" if c != "n" else "_n"), F.col(f"k_{c}")) for c in [*v, "n"]})
            else:
                w = F.coalesce(F.get("hubs", F.lit(p))["w"] * F.col("_n") / (F.col("_n") + HALF), F.lit(0.0))
                t = t.withColumns({f"_{c}": F.col(f"_{c}") + F.coalesce(w * F.col(f"_s_{c}") / F.col("_n"), F.lit(0.0)) for c in v} | {"_rest": F.col("_rest") + w})
            t = t.drop("_hub", "_n", *[f"_s_{c}" for c in v])
        n = F.col("k_n") + F.col("m0")
        t = t.withColumn("_first", F.when(F.col("hub").isNotNull(), F.col("w") * n / (n + HALF)).otherwise(0.0)).withColumn("_all", F.col("_rest") + F.col("_first"))
        # hub's mean L = (observed + sum of members' estimates) / n, with estimate = (w L + rest) / all
        t = between = scratch.put(t)  # two plans read it
        solved = t.where("hub IS NOT NULL AND _all > 0").groupBy("hub").agg(F.sum(F.col("_first") / F.col("_all")).alias("_a"), *[F.sum(F.col(f"_{c}") / F.col("_all")).alias(f"_b_{c}") for c in v])
        t = lookup(t, solved, "hub", "left", total=total)
        left = n - F.coalesce("_a", F.lit(0.0))
        there = F.col("hub").isNotNull() & (left > 1e-9)
        bottom = F.col("_rest") + F.when(there, F.col("_first")).otherwise(0.0)
        est = {f"_e_{c}": F.when(bottom > 0, (F.col(f"_{c}") + F.when(there, F.col("_first") * (F.col(f"k_{c}") + F.col(f"_b_{c}")) / left).otherwise(0.0)) / bottom) for c in v}
        moves = [F.when(F.col(f"_e_{c}").isNotNull(), F.abs(F.col(f"_e_{c}") - F.coalesce(F.col(c), F.col(f"_e_{c}") + F.col("unit"))) / F.col("unit")) for c in v]
        fixed = ["cell", "unit", "hubs", "hub", "w", "prior", "m0"]
        kept = [F.col(f"k_{c}") for c in [*v, "n"]] if not mixed else []
        t = t.withColumns(est).withColumn("move", F.greatest(*moves, F.lit(0.0)))
        out = t.select(*fixed, *kept, *[F.col(f"_e_{c}").alias(c) for c in v], "move")
        if mixed:  # observed sums are those of the start
            out = lookup(out, base.drop("m0"), "hub", "left", total=total).withColumns({f"k_{c}": F.coalesce(f"k_{c}", F.lit(0.0)) for c in [*v, "n"]})
        nxt = scratch.put(out)
        far = nxt.agg(F.max("move")).first()[0]
        scratch.drop(state, between)
        state = nxt
        if far is None or far <= tolerance:
            return state.where(F.col("v0").isNotNull()).select("cell", *v)
    raise RuntimeError(f"estimates still move by {far} after {rounds} rounds")


def quotient_propagation(levels: Sequence[tuple[Sequence[str], float]], width: int, prior: Sequence[float] | None = None, own_weight: float = 0.0, prior_weight: float = 0.001, rounds: int = 5000, tolerance: float = 1e-4):
    """Grouped-map function: estimates of the profiles of one or more components.

    Rows have the level columns, observed counts c0 .. c{width-1}, ``m`` missing cells, and, with
    ``own_weight``, counts o0 .. of the hub that a profile's missing cells have for themselves; the
    result adds p0 .. p{width-1}, null where no level knows a value. ``prior`` is the mean of a hub
    that all cells share.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf[[f"c{i}" for i in range(width)]].to_numpy(float)
        m = pdf["m"].to_numpy(float)[:, None]
        groups = []
        for cols, w in levels:
            key = pdf.groupby(list(cols), dropna=False, sort=False).ngroup().to_numpy() if cols else np.zeros(len(pdf), dtype=int)
            base = np.zeros((key.max(initial=-1) + 1, width))
            np.add.at(base, key, counts)
            groups.append((key, base, w))
        top0, bottom0 = np.zeros_like(counts), np.zeros(len(pdf))
        if own_weight:
            own = pdf[[f"o{i}" for i in range(width)]].to_numpy(float)
            n = own.sum(1)
            bottom0 = own_weight * n / (n + HALF)
            top0 = own / np.maximum(n, 1e-12)[:, None] * bottom0[:, None]
        if prior is not None:
            top0, bottom0 = top0 + prior_weight * np.asarray(prior, float), bottom0 + prior_weight
        est = np.zeros_like(counts)
        spoken = np.zeros(len(pdf), dtype=bool)
        far = 0.0
        for _ in range(rounds):
            top, bottom = top0.copy(), bottom0.copy()
            for key, base, w in groups:
                s = base.copy()
                np.add.at(s, key, est * m)
                n = s.sum(1)
                share = s / np.maximum(n, 1e-12)[:, None]
                weight = w * n / (n + HALF)
                top += (share * weight[:, None])[key]
                bottom += weight[key]
            new = top / np.maximum(bottom, 1e-12)[:, None]
            spoken = bottom > 0
            far = np.abs(new - est).max(initial=0)
            est = new
            if far <= tolerance:
                break
        else:
            raise RuntimeError(f"estimates still move by {far} after {rounds} rounds")
        est[~spoken] = np.nan
        return pdf.assign(**{f"p{i}": est[:, i] for i in range(width)})

    return run


def first_largest(cols: Sequence[str]) -> Column:
    """Index of the largest of ``cols``, the first among equals; null if all are null."""
    top = F.greatest(*cols)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(cols))):
        out = F.when(F.col(cols[i]) == top, F.lit(i)).otherwise(out)
    return F.when(top.isNotNull(), out)


def allele_code(c: Column) -> Column:
    """0 to 3, blanks around it ignored; null for anything else."""
    direct = F.when(c.isin("0", "1", "2", "3"), c.cast("int"))
    return F.coalesce(direct, F.when(F.length(c) > 1, F.nullif(F.regexp_extract(c, r"(?U)^\s*([0-3])\s*$", 1), F.lit("")).cast("int")))


def _hash_key(c: str, salt: str) -> Column:
    """64-bit key of a group; a null group is a group of its own for each row."""
    return F.coalesce(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.xxhash64(F.lit("null"), salt))


def line_subpops(indiv: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ln, sp): the commonest known subpopulation of each line, the first among equals."""
    spelled = F.upper(F.regexp_replace("subpop", r"(?U)^\s+|\s+$", ""))
    code = F.array_position(F.array(*[F.lit(n.upper()) for n in names]), spelled) - 1
    known = indiv.where("lineid IS NOT NULL AND indiv_id IS NOT NULL").select("indiv_id", F.xxhash64("lineid").alias("ln"), code.cast("int").alias("sp")).where("sp >= 0").distinct()
    return known.groupBy("ln", "sp").agg(F.count(F.lit(1)).alias("n")).groupBy("ln").agg(F.min_by("sp", F.struct(-F.col("n"), "sp")).alias("sp"))


class Calls:
    """Genotype calls prepared for filling; see :func:`fill_calls`."""

    def __init__(self, snps: DataFrame, line_sp: DataFrame, scratch: Scratch):
        c = [f"c{i}" for i in range(ALLELES)]
        when = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
        rows = snps.where("call_id IS NOT NULL").select(
            "call_id", _hash_key("id", "call_id").alias("mk"), _hash_key("lineid", "call_id").alias("ln"), "chromosome", "pos", F.coalesce(allele_code(F.col("allele")), F.lit(-1)).alias("code"), when.alias("at")
        )
        # a repeat has the marker and line of its first row, so all group keys are of fixed width
        self.calls = scratch.put(rows.groupBy("call_id", "mk", "ln", "chromosome", "pos").agg(F.max_by("code", "at").cast("byte").alias("code")))
        # counted before the shuffle: the check line shrinks to one row a marker and task
        cells = self.calls.groupBy("ln", "chromosome", "mk").agg(
            F.min("pos").alias("pos"), *[F.count_if(F.col("code") == i).alias(f"c{i}") for i in range(ALLELES)], F.count_if(F.col("code") < 0).alias("m")
        )
        mode = F.when(sum((F.col(x) for x in c), F.lit(0)) > 0, first_largest(c)).otherwise(-1).cast("byte")
        w = Window.partitionBy("ln", "chromosome").orderBy("pos", "mk")  # a row a marker at most
        cells = cells.withColumn("mode", mode)
        cells = cells.withColumn("la", F.coalesce(F.lag("mode").over(w), F.lit(-1).cast("byte"))).withColumn("ra", F.coalesce(F.lead("mode").over(w), F.lit(-1).cast("byte")))
        self.cells = scratch.put(cells.drop("pos").join(bounded_broadcast(line_sp, BROADCAST_LINES), "ln", "left").withColumn("sp", F.coalesce("sp", F.lit(-1))))


#: Columns that cells share, and the weight of such a hub.
CALL_LEVELS = ((("mk", "sp", "la", "ra"), 4.0), (("mk", "la", "ra"), 2.0), (("mk", "sp"), 1.0), (("mk",), 0.05))
#: About so many profiles go to one task.
PROFILE_ROWS = 4_000
OWN_WEIGHT = 50.0


def call_profiles(calls: Calls) -> DataFrame:
    """Counts of each marker's profiles: subpopulation, alleles of the line's neighbouring markers, and
    the calls that a line with missing calls has itself at the marker (o0 ..)."""
    c = [f"c{i}" for i in range(ALLELES)]
    own = [F.when(F.col("m") > 0, F.col(x)).otherwise(0).alias(f"o{i}") for i, x in enumerate(c)]
    return calls.cells.select("mk", "sp", "la", "ra", *own, *c, "m").groupBy("mk", "sp", "la", "ra", *[f"o{i}" for i in range(ALLELES)]).agg(*[F.sum(x).alias(x) for x in c], F.sum("m").alias("m"))


def fill_calls(calls: Calls, profiles: DataFrame) -> DataFrame:
    """(call_id, allele, share, how): a fill for every call without an allele.

    Hubs: calls of the same line and marker; lines of the same subpopulation and the same alleles
    on both sides; lines of the same alleles on both sides; lines of the same subpopulation; all
    lines at the marker; all calls (observed ones only). Fallback where no call at all has an
    allele: 0 with share 0.
    """
    c, p, o = ([f"{x}{i}" for i in range(ALLELES)] for x in "cpo")
    schema = ", ".join(["mk long", "sp int", "la byte", "ra byte", *[f"{x} long" for x in [*o, *c]], "m long", *[f"{x} double" for x in p]])
    seen = profiles.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in c]).first()
    every = sum(seen[x] for x in c)
    # whole markers go to a task, several at once: each level holds its marker
    tasks = max(8, -(-seen["n"] // PROFILE_ROWS))
    dealt = profiles.withColumn("_task", F.pmod(F.xxhash64("mk"), F.lit(tasks)).cast("int"))
    solve = quotient_propagation(CALL_LEVELS, ALLELES, [seen[x] / every for x in c] if every else None, OWN_WEIGHT)
    solved = dealt.groupBy("_task").applyInPandas(lambda pdf: solve(pdf.drop(columns="_task")), schema).where("m > 0").select("mk", "sp", "la", "ra", *o, *p)
    chromosome = F.coalesce("chromosome", F.lit(-1)).alias("ch")
    own = calls.cells.where("m > 0").select("mk", "ln", chromosome, "sp", "la", "ra", *[F.col(x).alias(y) for x, y in zip(c, o)])
    known = [F.when(~F.isnan(x), F.col(x)).alias(x) for x in p]
    filled = own.join(solved, ["mk", "sp", "la", "ra", *o]).select("mk", "ln", "ch", *known)
    found = F.greatest(*p) > 0
    allele = F.when(found, first_largest(p)).otherwise(0).cast("string").alias("allele")
    filled = filled.select("mk", "ln", "ch", F.struct(allele, F.when(found, F.greatest(*p)).otherwise(0.0).alias("share"), F.when(found, "propagated").otherwise("fallback").alias("how")).alias("f"))
    lost = calls.calls.where("code < 0").select("call_id", "mk", "ln", chromosome)
    return lost.join(filled, ["mk", "ln", "ch"]).groupBy("call_id").agg(F.min("f").alias("f")).select("call_id", "f.*")


def latest_individuals(indiv: DataFrame) -> DataFrame:
    """One row an indiv_id: that of the latest loaded_at."""
    cols = [c for c in indiv.columns if c != "indiv_id"]
    when = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
    return indiv.where("indiv_id IS NOT NULL").groupBy("indiv_id").agg(F.max_by(F.struct(*cols), when).alias("r")).select("indiv_id", "r.*")


def _hub(kind: str, w: float, *parts: Column) -> Column:
    name = F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts])
    there = parts[0].isNotNull() if parts else F.lit(True)
    for q in parts[1:]:
        there = there & q.isNotNull()
    return F.when(there, F.struct(name.alias("hub"), F.lit(w).alias("w")))


def fill_traits(people: DataFrame, traits: Sequence[tuple[int, float, float]], scratch: Scratch) -> DataFrame:
    """(indiv_id, trait_no, value, how): a fill for every trait (number, least, most) that a list lacks.

    ``people`` has indiv_id, lineid, trial, month, traitvalue and sp. Hubs of a trait: the line's
    other trials; the subpopulation within the trial; the trial; the subpopulation; the month of
    measuring; all. Fallback: the middle of the trait's range.
    """
    t = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("trait_no"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, lo, hi in traits]))
    cells = people.select("indiv_id", "lineid", "trial", "month", "sp", "traitvalue", t.alias("t")).select("*", "t.*")
    value = F.get("traitvalue", F.col("trait_no") - 1).cast("double")
    sound = F.when(value.isNotNull() & ~F.isnan(value) & value.between(F.col("lo"), F.col("hi")), value)
    k = F.col("trait_no")
    sp = F.when(F.col("sp") >= 0, F.col("sp"))
    hubs = F.array(_hub("l", 8.0, k, F.col("lineid")), _hub("ts", 1.5, k, F.col("trial"), sp), _hub("t", 1.0, k, F.col("trial")), _hub("s", 1.0, k, sp), _hub("m", 0.2, k, F.col("month")), _hub("g", 0.01, k))
    cells = scratch.put(cells.select("indiv_id", "trait_no", "lo", "hi", sound.alias("v0"), hubs.alias("hubs")))
    gaps = cells.where("v0 IS NULL").withColumn("cell", F.struct("indiv_id", "trait_no")).withColumn("span", F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)))
    est = propagate(cells.where("v0 IS NOT NULL"), gaps, 1, scratch, scale="span")
    middle = gaps.select("cell", "indiv_id", "trait_no", ((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    how = F.when(F.col("v0").isNotNull(), "propagated").otherwise("fallback").alias("how")
    return middle.join(est, "cell", "left").select("indiv_id", "trait_no", F.coalesce("v0", "mid").alias("value"), how)


def fill_subpops(people: DataFrame, names: Sequence[str], default: int, genotype: DataFrame, scratch: Scratch) -> DataFrame:
    """(indiv_id, subpop, share, how): a fill for every individual whose subpopulation is not known.

    ``people`` has indiv_id, lineid, trial, label and own (code or null); ``genotype`` has ln and
    g0 .. : what the alleles of a line without a known subpopulation say, a hub of observed members
    only. Hubs: the line; its alleles; the label within the trial; all.
    """
    width = len(names)
    v = [f"v{i}" for i in range(width)]
    label = F.when(F.col("label") > 0, F.col("label"))
    hubs = F.array(_hub("l", 20.0, F.col("lineid")), _hub("lt", 0.5, label, F.col("trial")), _hub("g", 0.01, F.lit(0)))
    cells = scratch.put(people.select("indiv_id", F.xxhash64("lineid").alias("ln"), "own", hubs.alias("hubs")))
    seen = cells.where("own IS NOT NULL").select("hubs", *[F.when(F.col("own") == i, 1.0).otherwise(0.0).alias(f"v{i}") for i in range(width)])
    gaps = cells.where("own IS NULL").select(F.col("indiv_id").alias("cell"), "hubs", "ln")
    said = genotype.select("ln", F.array(*[F.col(f"g{i}") for i in range(width)]).alias("said"))
    est = propagate(seen, lookup(gaps, said, "ln", "left", total=people.count()), width, scratch, prior="said", prior_weight=4.0)
    met = gaps.select("cell").join(est, "cell", "left")
    found = F.coalesce(F.greatest(*v) > 0, F.lit(False))
    code = F.when(found, first_largest(v)).otherwise(F.lit(default))
    name = F.get(F.array(*[F.lit(n) for n in names]), code).alias("subpop")
    return met.select(F.col("cell").alias("indiv_id"), name, F.when(found, F.greatest(*v)).otherwise(0.0).alias("share"), F.when(found, "propagated").otherwise("fallback").alias("how"))


def genotype_subpops(calls: Calls, profiles: DataFrame, width: int) -> DataFrame:
    """(ln, g0 ..) of the lines without a known subpopulation: the mean, over their markers, of how
    common the line's allele is in each subpopulation (each subpopulation counting alike)."""
    c = [f"c{i}" for i in range(ALLELES)]
    by_sp = profiles.where("sp >= 0").groupBy("mk", "sp").agg(*[F.sum(x).alias(x) for x in c])
    n = sum((F.col(x) for x in c), F.lit(0))
    flat = by_sp.where(n > 0).select("mk", "sp", F.posexplode(F.array(*[F.col(x) / n for x in c])).alias("mode", "f"))
    wide = flat.groupBy("mk", "mode").agg(F.sum("f").alias("t"), *[F.sum(F.when(F.col("sp") == i, F.col("f")).otherwise(0.0)).alias(f"g{i}") for i in range(width)]).where("t > 0")
    wide = wide.select("mk", F.col("mode").cast("byte").alias("mode"), *[(F.col(f"g{i}") / F.col("t")).alias(f"g{i}") for i in range(width)])
    return calls.cells.where("sp < 0 AND mode >= 0").select("ln", "mk", "mode").join(wide, ["mk", "mode"]).groupBy("ln").agg(*[F.avg(f"g{i}").alias(f"g{i}") for i in range(width)])


def _few(table: DataFrame, most: int) -> list:
    """Rows of a table that is small by its meaning; more than ``most`` raise."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def fill_project(snps: DataFrame, indiv: DataFrame, pheno: DataFrame, subpops: DataFrame) -> DataFrame:
    """(tbl, row_id, field, item, value_text, value_number, share, how): one row a filled cell.

    ``share`` is the weight of the chosen category; ``how`` is propagated, or fallback where no hub
    knows a value.
    """
    scratch = Scratch(snps.sparkSession, "filling")
    # two fixed tables: 6 and 7 rows
    traits = [(r["trait_no"], r["min_value"], r["max_value"]) for r in _few(pheno.where("trait_no >= 1").orderBy("trait_no"), 10_000)]
    known = _few(subpops.where("subpop IS NOT NULL").orderBy("subpop"), 1_000)
    names = [r["subpop"].strip() for r in known]
    default = max(range(len(known)), key=lambda i: (known[i]["n_founders"] or 0, -i)) if known else 0

    people = scratch.put(latest_individuals(indiv))
    line_sp = scratch.put(line_subpops(people, names))
    calls = Calls(snps, line_sp, scratch)
    profiles = scratch.put(call_profiles(calls))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def rows(df: DataFrame, tbl: str, row_id: str, field: str, item: Column, value_text: Column, value_number: Column, share: Column) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.col(row_id).alias("row_id"), F.lit(field).alias("field"), item.cast("int").alias("item"), value_text.alias("value_text"), value_number.alias("value_number"), share.alias("share"), "how")

    out = rows(fill_calls(calls, profiles), "ift_snps", "call_id", "allele", F.lit(0), F.col("allele"), number, F.col("share"))
    spelled = F.upper(F.regexp_replace("subpop", r"(?U)^\s+|\s+$", ""))
    own = F.nullif(F.array_position(F.array(*[F.lit(n.upper()) for n in names]), spelled).cast("int"), F.lit(0)) - 1
    month = F.date_format("measured_at", "yyyy-MM") if "measured_at" in people.columns else text
    coded = lookup(people.withColumn("own", own).withColumn("ln", F.xxhash64("lineid")), line_sp, "ln", "left", total=people.count())
    coded = coded.withColumn("sp", F.coalesce("own", "sp", F.lit(-1))).withColumn("month", month)
    if traits:
        out = out.unionByName(rows(fill_traits(coded, traits, scratch), "ift_indiv", "indiv_id", "traitvalue", F.col("trait_no"), text, F.col("value"), number))
    if names:
        genotype = scratch.put(genotype_subpops(calls, profiles, len(names)))
        out = out.unionByName(rows(fill_subpops(coded, names, default, genotype, scratch), "ift_indiv", "indiv_id", "subpop", F.lit(0), F.col("subpop"), number, F.col("share")))
    return out
