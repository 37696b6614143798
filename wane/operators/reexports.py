"""Where the names of a library are defined: imports followed through its modules.

``library_names`` flattens every module of a scanned tree to rows. A name that a module imports is an edge to the module and name it
comes from; ``import *`` gives edges for the public names of the other module. ``re_exports`` follows the edges of all names at once, one
join a round, to their definition. The rounds are as many as the longest chain; a name that leads back to itself is reported as a
cycle. Trees (snapshots of libraries) never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane.functions.syntax import module_names
from wane.session import cut_lineage

KEY = ["tree", "module", "name"]


def _joined(a: Column, b: Column) -> Column:
    """a.b where both are there."""
    return F.concat_ws(".", F.when(a != "", a), F.when(b != "", b))


def library_names(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """(tree, module, name, kind, to_module, to_name, made, seq) for ``file, prefix, source`` rows; ``by`` names the columns that tell trees apart.

    Every round of following names reads these rows again, so they are checkpointed: a file is parsed once.
    """
    package = F.col("file").rlike(r"(^|/)__init__\.pyi?$")
    tree = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")
    rows = files.select(tree.alias("tree"), F.coalesce("prefix", F.lit("")).alias("module"), package.alias("package"), F.explode_outer(module_names("source")).alias("n"))
    parts = F.split("module", "[.]")
    up = F.size(parts) - F.col("n.level") + F.col("package").cast("int")
    base = F.when(up > 0, F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(1))), ".")).otherwise(F.lit(""))
    path = F.coalesce("n.path", F.lit(""))
    source = F.when(F.col("n.level") > 0, _joined(base, path)).otherwise(path)
    kind = F.col("n.kind")
    return cut_lineage(rows.select(
        "tree", "module", F.coalesce("n.name", F.lit("")).alias("name"), F.coalesce(kind, F.lit("empty")).alias("kind"),
        F.when(kind == "alias", F.col("module")).when(kind.isin("module", "import", "star"), source).alias("to_module"),
        F.when(kind.isin("import", "alias"), F.col("n.member")).alias("to_name"), F.col("n.made").alias("made"), F.col("n.seq").alias("seq")))


def _with_stars(names: DataFrame) -> DataFrame:
    """One row for each name of a module, those that ``import *`` brings among them."""
    own = names.where(~F.col("kind").isin("star", "public", "empty"))
    # a definition comes before an import, an import before another value (a fallback where the import fails), then the first of them
    rank = F.struct(F.when(F.col("kind").isin("function", "class"), 0).when(F.col("kind") == "value", 2).otherwise(1).alias("x"), "seq")
    held = cut_lineage(own.groupBy(*KEY).agg(
        F.min_by("kind", rank).alias("kind"), F.min_by("to_module", rank).alias("to_module"), F.min_by("to_name", rank).alias("to_name")))
    stars = names.where("kind = 'star'").select("tree", F.col("module").alias("into"), F.col("to_module").alias("module")).distinct()
    listed = names.where("kind = 'public'").select(*KEY).distinct()
    with_list = listed.select("tree", "module").distinct().withColumn("lists", F.lit(True))
    fresh = held
    while True:
        # names that became known in the last round reach the modules that import all of them
        public = fresh.select(*KEY).join(with_list, ["tree", "module"], "left").join(listed.withColumn("listed", F.lit(True)), KEY, "left")
        public = public.where(F.when(F.col("lists"), F.col("listed")).otherwise(~F.col("name").startswith("_") & ~F.contains("name", F.lit("."))))
        brought = public.join(stars, ["tree", "module"]).groupBy("tree", F.col("into").alias("module"), "name").agg(F.min("module").alias("to_module"))
        fresh = brought.join(held, KEY, "left_anti").select(*KEY, F.lit("import").alias("kind"), "to_module", F.col("name").alias("to_name"))
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            return held
        held = cut_lineage(held.unionByName(fresh))


def re_exports(names: DataFrame) -> DataFrame:
    """(tree, from_symbol, to_symbol, kind, hops) for every name that a module imports or renames.

    ``kind`` tells where the chain ends: ``defined`` at a definition, ``module`` at a module, ``outside`` in a module that was not scanned,
    ``missing`` at a name that its module does not have, ``cycle`` if it never ends (then to_symbol is null).
    """
    table = _with_stars(names)
    modules = names.select("tree", "module").distinct()
    edges = table.where("kind in ('import', 'module', 'alias')").withColumnRenamed("kind", "_kind")
    step = table.select(*KEY, F.col("kind").alias("_kind"), F.col("to_module").alias("_module"), F.col("to_name").alias("_name"))
    at = F.concat_ws(":", "at_module", "at_name")
    now = edges.select(
        "tree", _joined(F.col("module"), F.col("name")).alias("from_symbol"), F.col("to_module").alias("at_module"), F.col("to_name").alias("at_name"),
        F.array(F.concat_ws(":", "module", "name")).alias("seen"))
    known = modules.select("tree", F.col("module").alias("_scanned"), F.lit(True).alias("is_module"))
    finished = []
    while True:
        # a dotted name continues below the name that its first part leads to
        head, rest = F.split_part("at_name", F.lit("."), F.lit(1)), F.regexp_extract("at_name", r"\.(.*)$", 1)
        looked = now.withColumn("_head", head).withColumn("_rest", rest)
        looked = looked.join(step.withColumnsRenamed({"module": "at_module", "name": "_head"}), ["tree", "at_module", "_head"], "left")
        looked = looked.join(known.withColumnsRenamed({"_scanned": "at_module", "is_module": "inside"}), ["tree", "at_module"], "left")
        below = F.concat_ws(".", "at_module", "_head")
        looked = looked.withColumn("below", below).join(known.withColumnsRenamed({"_scanned": "below", "is_module": "sub"}), ["tree", "below"], "left")
        inside, sub = F.coalesce("inside", F.lit(False)), F.coalesce("sub", F.lit(False))
        again = F.array_contains("seen", at)
        whole = _joined(F.col("at_module"), F.coalesce("at_name", F.lit("")))
        link = F.col("_kind").isin("import", "module", "alias")
        # "from . import part" names the part itself
        to_itself = F.coalesce(link & (F.col("_module") == F.col("at_module")) & (F.col("_name") == F.col("_head")), F.lit(False))
        enters = sub & (F.col("_kind").isNull() | to_itself)
        end = (
            F.when(F.coalesce("at_name", F.lit("")) == "", F.when(inside, F.lit("module")).otherwise(F.lit("outside")))
            .when(enters, F.when(F.col("_rest") == "", F.lit("module")))
            .when(again | to_itself, F.lit("cycle"))
            .when(F.col("_kind").isin("function", "class", "value"), F.lit("defined"))
            .when(link, F.lit(None))
            .when(inside, F.lit("missing")).otherwise(F.lit("outside")))
        name = F.when(enters, F.col("_rest")).otherwise(_joined(F.coalesce("_name", F.lit("")), F.col("_rest")))
        looked = looked.select(
            "tree", "from_symbol", F.when(enters, F.col("below")).otherwise(F.col("_module")).alias("next_module"), name.alias("next_name"),
            F.array_append("seen", at).alias("seen"), end.alias("kind"), whole.alias("to_symbol"))
        looked = cut_lineage(looked)
        finished.append(looked.where("kind is not null").select(
            "tree", "from_symbol", F.when(F.col("kind") != "cycle", F.col("to_symbol")).alias("to_symbol"), "kind", (F.size("seen") - 1).alias("hops")))
        now = looked.where("kind is null").select(
            "tree", "from_symbol", F.col("next_module").alias("at_module"), F.col("next_name").alias("at_name"), "seen")
        if now.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def returned(names: DataFrame, exports: DataFrame) -> DataFrame:
    """(tree, function, made): the classes that annotated functions and methods return, by the names under which they are defined."""
    calls = names.where("kind = 'function' and size(made) > 0").select("tree", "module", F.col("name").alias("function"), F.explode("made").alias("of"))
    own = names.where("kind = 'class'").select("tree", "module", F.col("name").alias("of"), F.lit(True).alias("own")).distinct()
    calls = calls.join(own, ["tree", "module", "of"], "left")
    head = F.split_part("of", F.lit("."), F.lit(1))
    calls = calls.withColumn("from_symbol", _joined(F.col("module"), head)).withColumn("rest", F.regexp_extract("of", r"\.(.*)$", 1))
    found = calls.join(exports.where("to_symbol is not null").select("tree", "from_symbol", "to_symbol"), ["tree", "from_symbol"], "left")
    made = F.when(F.col("own"), _joined(F.col("module"), F.col("of"))).otherwise(_joined(F.col("to_symbol"), F.col("rest")))
    return found.where("own or to_symbol is not null").select("tree", _joined(F.col("module"), F.col("function")).alias("function"), made.alias("made")).distinct()


def _renamed(each: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbols with their longest known beginning replaced by what it stands for; part before the first call only."""
    before = F.split_part("symbol", F.lit("()"), F.lit(1))
    parts = F.split(before, "[.]")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    asked = each.select("symbol").distinct().select("symbol", F.explode(starts).alias("from_symbol"))
    known = aliases.where("to_symbol is not null and from_symbol <> to_symbol").select("from_symbol", "to_symbol").distinct()
    longest = asked.join(known, "from_symbol").groupBy("symbol").agg(
        F.max(F.length("from_symbol")).alias("n"), F.collect_set(F.struct(F.length("from_symbol").alias("n"), "to_symbol")).alias("to"))
    longest = longest.select("symbol", F.explode(F.filter("to", lambda t: t["n"] == F.col("n"))).alias("to"))
    longest = longest.select("symbol", F.concat("to.to_symbol", F.expr("substring(symbol, to.n + 1)")).alias("renamed"))
    return each.join(longest, "symbol", "left").withColumn("symbol", F.coalesce("renamed", "symbol")).drop("renamed")


def traced(each: DataFrame, aliases: DataFrame | None, returns: DataFrame | None, calls: int = 3) -> DataFrame:
    """Symbols as snippets write them, led to the names under which they are defined. A row may give several: the name as written and as
    defined (``variant`` 1 and 0), and each class that a function may return. Results of more than ``calls`` calls in a row stay unknown."""
    now = each.withColumn("variant", F.lit(0))
    if aliases is not None:
        now = _renamed(now, aliases).unionByName(each.withColumn("variant", F.lit(1)))
    if returns is not None:
        made = returns.select("function", "made").distinct()
        for _ in range(calls):
            now = now.withColumn("function", F.when(F.contains("symbol", F.lit("()")), F.split_part("symbol", F.lit("()"), F.lit(1))))
            now = now.join(made, "function", "left")
            open_ = F.col("function").isNotNull()
            now = now.where(~open_ | F.col("made").isNotNull()).withColumn(
                "symbol", F.when(open_, F.concat("made", F.expr("substring(symbol, length(function) + 3)"))).otherwise(F.col("symbol"))).drop("function", "made")
            if aliases is not None:
                now = _renamed(now, aliases)
    return now.where(~F.contains("symbol", F.lit("()"))).distinct()
