import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arborgrid.operators import filling
from arborgrid.plans import Scratch

SNPS = "call_id long, id string, chromosome int, pos int, lineid string, allele string, run_id long, loaded_at timestamp, mk string"
INDIV = "indiv_id long, lineid string, subpop string, traitvalue array<float>, label int, pos int, trial string, loaded_at timestamp, cell string"
T0 = dt.datetime(2024, 1, 1)


def tables(spark, snps, indiv):
    pheno = spark.createDataFrame([(1, "height", 0.0, 100.0), (2, "mass", 10.0, 20.0)], "trait_no int, traitname string, min_value double, max_value double")
    subpops = spark.createDataFrame([("AAA", 5), ("BBB", 9)], "subpop string, n_founders int")
    return spark.createDataFrame(snps, SNPS), spark.createDataFrame(indiv, INDIV), pheno, subpops


def population(rng, lines=120, markers=30):
    """Two subpopulations with their own common allele at each marker."""
    snps, truth, n = [], {}, 0
    for ln in range(lines):
        pop = ln % 2
        for m in range(markers):
            allele = (0 if (m + pop) % 2 else 2) if rng.random() < 0.95 else 1
            hide = rng.random() < 0.1
            snps.append((n, f"m{m}", m % 3, m * 10, f"L{ln}", rng.choice([None, "", "--", "9", "NA"]) if hide else rng.choice(["{}", " {}", "{}\t"]).format(allele), 1, T0, "x"))
            if hide:
                truth[n] = str(allele)
            n += 1
    indiv = [(ln, f"L{ln}", ["AAA", "BBB"][ln % 2] if ln % 10 else None, [50.0 + 30 * (ln % 2) + rng.random(), None if ln % 7 == 0 else 15.0], ln % 2 + 1, -1, "T1", T0, "x") for ln in range(lines)]
    return snps, indiv, truth


def test_fills_are_near_the_truth_and_complete(spark):
    snps, indiv, truth = population(random.Random(1))
    got = filling.fill_project(*tables(spark, snps, indiv)).toPandas()
    alleles = got[got.field == "allele"].set_index("row_id").value_text
    assert set(alleles.index) == set(truth)
    assert sum(alleles[k] == v for k, v in truth.items()) / len(truth) > 0.85
    pops = got[got.field == "subpop"].set_index("row_id").value_text
    assert set(pops.index) == set(range(0, 120, 10)) and (pops == ["AAA", "BBB"][0]).all()  # lines 0, 10, ... are of the first
    traits = got[got.field == "traitvalue"]
    assert set(zip(traits.row_id, traits["item"])) == {(i, 2) for i in range(0, 120, 7)} and (traits.value_number.round(3) == 15).all()


def test_dirty_rows(spark):
    snps = [(1, None, None, None, None, None, None, None, None), (2, "m", 1, 5, "L", " 3 ", 1, T0, ""), (2, "m", 1, 5, "L", " 3 ", 1, None, ""), (3, "m", 1, 5, "L", "4", 1, T0, ""), (3, "m", 1, 5, "L", "4", 1, T0, ""), (None, "m", 1, 5, "L", "x", 1, T0, "")]
    nan, inf = float("nan"), float("inf")
    indiv = [(1, None, " aaa ", None, None, None, None, None, ""), (2, "L", "zzz", [], 0, -1, "T", T0, ""), (3, "L", None, [nan, inf], 0, -1, "T", T0, ""), (4, "L", "bbb", [100.0, 20.1], 1, -1, "T", T0, ""), (4, "L", "bbb", [100.0, 20.1], 1, -1, "T", T0, "")]
    got = filling.fill_project(*tables(spark, snps, indiv)).toPandas()
    cells = sorted(zip(got.tbl, got.row_id, got.field, got["item"]))
    want = [("ift_snps", 1, "allele", 0), ("ift_snps", 3, "allele", 0), ("ift_indiv", 2, "subpop", 0), ("ift_indiv", 3, "subpop", 0)]
    want += [("ift_indiv", i, "traitvalue", k) for i in (1, 2, 3) for k in (1, 2)] + [("ift_indiv", 4, "traitvalue", 2)]
    assert cells == sorted(want)
    value = {(r.row_id, r.field, r.item): r.value_text or r.value_number for r in got.itertuples()}
    assert value[(3, "allele", 0)] == "3" and value[(1, "allele", 0)] == "3"  # a marker never read: the commonest allele of all calls
    assert value[(2, "subpop", 0)] == "BBB" and abs(value[(2, "traitvalue", 1)] - 100) < 1e-6 and value[(4, "traitvalue", 2)] == 15.0


def test_empty_tables(spark):
    assert filling.fill_project(*tables(spark, [], [])).count() == 0


def test_propagation_passes_values_on(spark):
    """c1 shares a hub with an observed cell, c2 only with c1."""
    hub = "array<struct<hub:string,w:double>>"
    seen = spark.createDataFrame([(8.0, [("a", 1.0)])], f"v0 double, hubs {hub}")
    gaps = spark.createDataFrame([("c1", [("a", 1.0), ("b", 1.0)]), ("c2", [("b", 1.0)]), ("c3", [("z", 1.0)])], f"cell string, hubs {hub}")
    got = {r["cell"]: round(r["v0"], 6) for r in filling.propagate(seen, gaps, 1, Scratch(spark)).collect()}
    assert got == {"c1": 8.0, "c2": 8.0}


def test_propagation_is_the_fixpoint_of_all_hubs(spark):
    """Against plain iteration: line hubs first, trials, a prior, cells without a first hub, and a first
    hub that is another cell's later one."""
    rng = random.Random(3)
    hub = "array<struct<hub:string,w:double>>"
    edge = lambda i: [(f"l{i % 17}", 8.0) if i % 11 else None, (f"t{i % 5}", 1.0), ("g", 0.01)] if i % 13 else [(f"t{i % 5}", 1.0), (f"l{i % 17}", 2.0)]
    seen, gaps = [], []
    for i in range(400):
        (gaps if rng.random() < 0.4 else seen).append((i, edge(i), rng.uniform(0, 9), [rng.uniform(0, 9)] if i % 29 == 0 else None))
    known, est = {}, {}
    for _, hubs, x, _ in seen:
        for h in filter(None, hubs):
            s, n = known.get(h[0], (0.0, 0))
            known[h[0]] = (s + x, n + 1)
    for _ in range(3000):
        now = dict(known)
        for i, hubs, _, _ in gaps:
            if i in est:
                for h in filter(None, hubs):
                    s, n = now.get(h[0], (0.0, 0))
                    now[h[0]] = (s + est[i], n + 1)
        for i, hubs, _, prior in gaps:
            parts = [(w * now[h][1] / (now[h][1] + 2), now[h][0] / now[h][1]) for h, w in filter(None, hubs) if h in now] + ([(3.0, prior[0])] if prior else [])
            est[i] = sum(w * x for w, x in parts) / sum(w for w, _ in parts)
    a = spark.createDataFrame([(x, h) for _, h, x, _ in seen], f"v0 double, hubs {hub}")
    b = spark.createDataFrame([(i, h, p) for i, h, _, p in gaps], f"cell int, hubs {hub}, p array<double>")
    got = {r["cell"]: r["v0"] for r in filling.propagate(a, b, 1, Scratch(spark), tolerance=1e-7, prior="p", prior_weight=3.0).collect()}
    assert set(got) == {g[0] for g in gaps} and max(abs(got[i] - est[i]) for i in got) < 1e-5


def test_no_convergence_raises(spark):
    hub = "array<struct<hub:string,w:double>>"
    seen = spark.createDataFrame([(8.0, [None, ("a", 1.0)])], f"v0 double, hubs {hub}")
    gaps = spark.createDataFrame([("c1", [None, ("a", 1.0), ("b", 1.0)]), ("c2", [None, ("b", 1.0)])], f"cell string, hubs {hub}")
    with pytest.raises(RuntimeError):
        filling.propagate(seen, gaps, 1, Scratch(spark), rounds=1)


def test_allele_codes(spark):
    texts = ["0", " 1", "2 ", "\t3\n", " 1 ", "4", "", " ", "01", "1 2", "-1", "nan", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(filling.allele_code(F.col("t"))).collect()]
    assert got == [0, 1, 2, 3, 1, None, None, None, None, None, None, None, None]
