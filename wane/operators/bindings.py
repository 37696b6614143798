"""What the names of a snippet stand for: set-valued resolution over its bindings.

A call is looked up in the innermost scope that binds its first name. Every binding that can reach the place counts: one is hidden by a
later one only where that one runs whenever the first does. Imports give a path, aliases and made values lead to other names, classes
to their methods or bases. All of this is a fold over the bindings of one row, so resolving shuffles nothing.

Paths of results of calls keep their brackets (`pandas.read_csv().iteritems`), but for classes, whose results are their instances.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = (
    "struct<todo:array<struct<symbol:string,scope:string,place:bigint,branch:array<int>,path:string,choice:bigint>>,"
    "done:array<struct<symbol:string,scope:string,place:bigint,branch:array<int>,path:string,choice:bigint>>>")
ITEMS = "array<struct<symbol:string,scope:string,place:bigint,branch:array<int>,path:string,choice:bigint>>"
#: Kinds of bindings that lead on to another name.
LINKS = ("alias", "made", "class")
OWN = "__main__."


def let(value: Column, body) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def reaching(bindings: Column, name: Column, scope: Column, place: Column, branch: Column) -> Column:
    """The bindings of a name that can reach a place of a scope."""

    def hidden(a, seen):
        return F.exists(
            seen, lambda b: (b["place"] > a["place"]) & (F.size(F.array_except(b["branch"], F.array_union(a["branch"], branch))) == 0))

    def apart(b):  # arms of one statement exclude each other
        return F.exists(b["branch"], lambda x: F.exists(branch, lambda y: (F.shiftright(x, 4) == F.shiftright(y, 4)) & (x != y)))

    def earlier(seen):
        return let(
            F.filter(seen, lambda b: (b["scope"] == scope) & (b["layer"] == 0) & (b["place"] < place)),
            lambda before: F.when(F.size(before) > 0, before).otherwise(seen))

    # the snippet's own bindings come before those of a preamble, inner scopes before outer ones
    near = lambda b: F.struct(b["layer"], -F.length(b["scope"]))
    named = F.filter(bindings, lambda b: (b["name"] == name) & scope.startswith(b["scope"]))
    nearest = let(named, lambda seen: let(
        F.array_min(F.transform(seen, near)), lambda least: F.filter(seen, lambda b: (near(b) == least) & ~apart(b))))
    return let(let(nearest, earlier), lambda seen: F.filter(seen, lambda a: ~hidden(a, seen)))


def _item(symbol, scope, place, branch, path, choice) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (null if symbol is None else symbol).alias("symbol"), scope.alias("scope"), place.alias("place"), branch.alias("branch"),
        (null if path is None else path).alias("path"), choice.alias("choice"))


def _step(bindings: Column, item: Column) -> Column:
    """Where one name leads: finished symbols and names to go on with."""
    head = F.regexp_extract(item["path"], r"^[^.(]*", 0)
    rest = F.substring(item["path"], F.length(head) + 1, F.length(item["path"]))

    def lead(b, found):
        # where several bindings reach, each is a choice of its own
        choice = F.when(F.size(found) > 1, b["place"]).otherwise(item["choice"])
        at = (b["scope"], b["place"], b["branch"])
        member = F.regexp_replace(rest, r"^\(\)", "")
        own = (member == "") | F.array_contains(b["methods"], F.regexp_extract(member, r"^\.([^.(]*)", 1))
        through = F.transform(F.coalesce(b["bases"], F.array().cast("array<string>")), lambda x: _item(None, *at, F.concat(x, member), choice))
        none = F.array().cast(ITEMS)
        return (
            F.when(b["kind"] == "path", F.array(_item(F.concat(b["value"], rest), *at, None, choice)))
            .when((b["kind"] == "local") & (rest == ""), F.array(_item(F.concat(F.lit(OWN), b["value"]), *at, None, choice)))
            .when(b["kind"] == "alias", F.array(_item(None, *at, F.concat(b["value"], rest), choice)))
            .when(b["kind"] == "made", F.array(_item(None, *at, F.concat(b["value"], F.lit("()"), rest), choice)))
            .when((b["kind"] == "class") & own, F.array(_item(F.concat(F.lit(OWN), b["value"], member), *at, None, choice)))
            .when(b["kind"] == "class", F.filter(through, lambda x: F.regexp_extract(x["path"], r"^[^.(]*", 0) != ""))
            .otherwise(none).cast(ITEMS))

    return let(
        reaching(bindings, head, item["scope"], item["place"], item["branch"]),
        lambda found: F.flatten(F.transform(found, lambda b: lead(b, found))))


def symbols(call: Column, bindings: Column, layer: int = 1) -> Column:
    """Different symbols that a call may denote, in the order of their bindings; none if nothing is known.

    ``layer`` names the preamble that supplies what the snippet does not bind. For a method that several bases may have the first
    base that leads anywhere counts.
    """
    visible = F.filter(bindings, lambda b: b["layer"].isin(0, layer))
    none = F.array().cast(ITEMS)
    start = F.transform(call["names"], lambda n: _item(
        None, call["scope"], call["place"], call["branch"], n, F.lit(0).cast("bigint")).cast(ITEMS[6:-1]))
    # every step follows one binding, so more steps than links only go in circles
    steps = F.sequence(F.lit(1), F.size(F.filter(visible, lambda b: b["kind"].isin(*LINKS))) + 2)

    def go_on(state, _):
        found = F.flatten(F.transform(state["todo"], lambda i: _step(visible, i)))
        return F.when(F.size(state["todo"]) == 0, state).otherwise(let(found, lambda f: F.struct(
            F.array_distinct(F.filter(f, lambda i: i["symbol"].isNull())).alias("todo"),
            F.concat(state["done"], F.filter(f, lambda i: i["symbol"].isNotNull())).alias("done"))).cast(STATE))

    done = F.aggregate(steps, F.struct(start.alias("todo"), none.alias("done")).cast(STATE), go_on)["done"]
    # a class's name with brackets is an instance of it
    made = F.transform(done, lambda i: F.struct(
        F.regexp_replace(i["symbol"], r"((?:^|\.)\p{Lu}[^.()]*)\(\)", "$1").alias("symbol"), i["choice"].alias("choice")))
    usable = F.filter(made, lambda i: ~i["symbol"].startswith(OWN) | ~F.contains(i["symbol"], F.lit("()")))
    return let(usable, lambda all_: F.array_distinct(F.transform(
        F.array_distinct(F.transform(all_, lambda i: i["choice"])),
        lambda c: F.get(F.filter(all_, lambda i: i["choice"] == c), F.lit(0))["symbol"])))
