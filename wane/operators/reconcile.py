"""Reconcile two detection channels at client call sites."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.functions.names import compatible, leaf
from wane.functions.text import canonical_path
from wane.operators.ranking import id_bucket, positions
from wane.session import cut_lineage

_SITE = ["_file", "_line", "_leaf"]


def _site(df: DataFrame, file: str, symbol: str) -> DataFrame:
    return df.select(
        canonical_path(F.col(file)).alias("_file"), F.col("line").alias("_line"),
        leaf(F.col(symbol)).alias("_leaf"), F.col(symbol).alias("_sym"), F.col("ord").alias("_ord"))


def _classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """The names met at one site, in parts that have no compatible names in common.

    Compatible names share their leaf, so a site splits by leaf first. Each left name has its ``fits`` among the right names and the part
    these belong to; a part is ``clean`` if every left name of it fits all its right names.
    """
    names = left.select(*_SITE, "_sym", F.lit(True).alias("_l")).unionByName(
        right.select(*_SITE, "_sym", F.lit(False).alias("_l"))).distinct()
    site = names.groupBy(*_SITE).agg(
        F.array_sort(F.collect_list(F.when(F.col("_l"), F.col("_sym")))).alias("_ls"),
        F.array_sort(F.collect_list(F.when(~F.col("_l"), F.col("_sym")))).alias("_rs"),
    ).where((F.size("_ls") > 0) & (F.size("_rs") > 0))
    fits = F.transform(
        "_ls", lambda a: F.struct(a.alias("sym"), F.filter("_rs", lambda b: compatible(a, b)).alias("fits")))
    site = site.select(*_SITE, fits.alias("_fits")).withColumn("_fits", F.filter("_fits", lambda f: F.size(f["fits"]) > 0))

    def grow(parts, g):
        """Parts so far, with those that share a name with ``g`` and ``g`` itself as one."""
        apart = F.filter(parts, lambda p: ~F.arrays_overlap(p, g))
        joined = F.flatten(F.concat(F.filter(parts, lambda p: F.arrays_overlap(p, g)), F.array(g)))
        return F.array_append(apart, F.array_sort(F.array_distinct(joined)))

    groups = F.array_distinct(F.transform("_fits", lambda f: f["fits"]))
    parts = F.aggregate(groups, F.array().cast("array<array<string>>"), grow)
    site = site.select(*_SITE, "_fits", F.explode(parts).alias("_part"))
    mine = F.filter("_fits", lambda f: F.arrays_overlap(f["fits"], F.col("_part")))
    return site.select(*_SITE, "_part", mine.alias("_fits"), F.forall(mine, lambda f: f["fits"] == F.col("_part")).alias("_clean"))


def match_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-to-one pairs of orders: each left row, in order, takes the first free compatible right row.

    In a clean part the k-th left row meets the k-th right row, which is a join on the position. In other parts a row's choice depends on
    all rows before it, but only through the number of right rows that each name has given away; they are followed by a
    Python task for each part, as two numbers a row.
    """
    site = _classes(left, right)
    of_left = site.select(*_SITE, "_part", "_clean", F.explode("_fits").alias("f")).select(
        *_SITE, "_part", "_clean", F.col("f.sym").alias("_sym"), F.col("f.fits").alias("_fit"))
    of_right = site.select(*_SITE, "_part", "_clean", F.posexplode("_part").alias("_name", "_sym"))
    l, r = left.join(of_left, [*_SITE, "_sym"]), right.join(of_right, [*_SITE, "_sym"])
    keys = [*_SITE, "_part"]
    by_order = [F.col("_ord")]
    lp = positions(l.where("_clean"), keys, by_order, id_bucket(F.col("_ord")), "_k")
    rp = positions(r.where("_clean"), keys, by_order, id_bucket(F.col("_ord")), "_k")
    simple = lp.select(*keys, "_k", F.col("_ord").alias("_lo")).join(
        rp.select(*keys, "_k", F.col("_ord").alias("_ro")), [*keys, "_k"]).select("_lo", "_ro")

    # two digests stand for a part, and places of its names for what a row fits: no text goes to Python for each row
    group = [F.xxhash64(*keys).alias("_g"), F.xxhash64(F.lit(1), *keys).alias("_h")]
    places = F.array_join(F.transform("_fit", lambda x: F.array_position("_part", x) - 1), ",")
    l_mixed = l.where(~F.col("_clean")).select(*group, places.alias("_fit"), "_ord")
    r_mixed = r.where(~F.col("_clean")).select(*group, "_name", "_ord")

    def serve(key, a: pa.Table, b: pa.Table) -> pa.Table:
        """Eight bytes for each number of a row: Python objects exist for one row at a time."""
        numbers = lambda values: array("q", np.asarray(values, "int64").tobytes())
        name, order = b.column("_name").to_numpy(), b.column("_ord").to_numpy()
        queue = [numbers(np.sort(order[name == n])) for n in range(int(name.max(initial=-1)) + 1)]
        given = [0] * len(queue)
        sets, codes = {}, [np.empty(0, "int64")]
        for c in a.column("_fit").dictionary_encode().chunks:
            codes.append(np.array([sets.setdefault(s, len(sets)) for s in c.dictionary.to_pylist()], "int64")[c.indices.to_numpy()])
        code = np.concatenate(codes)
        fits = [[int(n) for n in s.split(",") if int(n) < len(queue)] for s in sets]
        where = a.column("_ord").to_numpy()
        first = np.argsort(where)
        lo, ro = array("q"), array("q")
        for place, one in zip(numbers(where[first]), numbers(code[first])):
            heads = [(queue[n][given[n]], n) for n in fits[one] if given[n] < len(queue[n])]
            if heads:
                taken, n = min(heads)
                given[n] += 1
                lo.append(place)
                ro.append(taken)
        return pa.table({"_lo": np.array(lo, "int64"), "_ro": np.array(ro, "int64")})

    mixed = l_mixed.groupBy("_g", "_h").cogroup(r_mixed.groupBy("_g", "_h")).applyInArrow(serve, "_lo bigint, _ro bigint")
    return simple.unionByName(mixed)


def reconcile(matches: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Merge catalog matches with type-checker diagnostics.

    Both: one row with joined origins and evidence. Left only: unchanged. Right only:
    a row flagged as recovered by the type checker. ``ord`` must be unique per side.
    """
    left = matches.withColumn("line", F.col("line").cast("int")).withColumn("ord", F.col("ord").cast("bigint"))
    right = diagnostics.withColumn("line", F.col("line").cast("int")).withColumn("ord", F.col("ord").cast("bigint"))
    ls, rs = _site(left, "client_file", "target_symbol"), _site(right, "file", "qualified_name")
    # used by both outcomes below
    pairs = cut_lineage(match_pairs(ls, rs).select("_lo", "_ro"))
    r = right.select(
        F.col("ord").alias("_ro"), F.col("file").alias("r_file"), F.col("line").alias("r_line"),
        F.col("qualified_name").alias("r_symbol"), F.col("raw_evidence").alias("r_evidence"),
        F.col("message").alias("r_message"), F.col("param_name").alias("r_param"), F.col("scope").alias("r_scope"),
        F.when(F.size("origins") > 0, F.col("origins")).otherwise(F.array("origin")).alias("r_origins"))
    paired = pairs.join(r, "_ro")
    both = left.join(paired, left["ord"] == paired["_lo"], "left")
    hit = F.col("_lo").isNotNull()
    new_text = hit & (F.coalesce("r_evidence", F.lit("")) != "") & ~F.contains("raw_evidence", F.col("r_evidence"))
    kept = both.select(
        "client_file", "line", "target_symbol",
        F.array_sort(F.when(hit, F.array_union("origins", "r_origins")).otherwise(F.col("origins"))).alias("origins"),
        F.when(new_text, F.concat("raw_evidence", F.lit(" | "), "r_evidence")).otherwise(F.col("raw_evidence")).alias("raw_evidence"),
        F.when(hit & (F.coalesce("message", F.lit("")) == ""), F.coalesce(F.when(F.col("r_message") != "", F.col("r_message")), F.col("message")))
        .otherwise(F.col("message")).alias("message"),
        F.lit(False).alias("is_typechecker_recovery"), "param_name", "scope",
        F.when(hit, F.lit("both")).otherwise(F.lit("catalog_only")).alias("case"),
        F.lit(0).alias("side"), "ord")
    alone = r.join(pairs, "_ro", "left_anti").select(
        F.col("r_file").alias("client_file"), F.col("r_line").alias("line"), F.col("r_symbol").alias("target_symbol"),
        F.array_sort("r_origins").alias("origins"), F.col("r_evidence").alias("raw_evidence"),
        F.col("r_message").alias("message"), F.lit(True).alias("is_typechecker_recovery"),
        F.col("r_param").alias("param_name"), F.col("r_scope").alias("scope"),
        F.lit("checker_only").alias("case"), F.lit(1).alias("side"), F.col("_ro").alias("ord"))
    return kept.unionByName(alone)


def in_scope(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions whose candidate is in the manifest, with the manifest's target."""
    return predictions.drop("target_api").join(manifest.select("candidate_id", "target_api"), "candidate_id")
