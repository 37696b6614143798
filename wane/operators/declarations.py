"""Deprecation evidence in library sources.

One parse per file yields definition rows; every rule is a column expression over
a definition, so all detectors share the parse and nothing is shuffled here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.syntax import definitions
from wane.functions.text import DEPRECATION, matching_paragraphs, strip

CANDIDATE = (
    "struct<qualified_name:string,origin:string,line:int,raw_evidence:string,"
    "origins:array<string>,scope:string,param_name:string,function_name:string,"
    "message:string,ord:bigint>"
)
DETECTORS = ("legacy", "comment", "parameter", "declared")


def is_category(name: Column, local: Column) -> Column:
    """A warning class that is, inherits from, or is named like a deprecation warning."""
    return (
        name.isin(fixed.STANDARD_CATEGORIES)
        | F.array_contains(local, name)
        | name.rlike(fixed.WARNING_CATEGORY)
    )


def local_warning_classes(defs: Column) -> Column:
    """(name, seq) of warning subclasses, each seen only by what follows it."""
    empty = F.array().cast("array<struct<name:string,seq:int>>")

    def add(acc, c):
        known = F.transform(acc, lambda a: a["name"])
        return F.when(
            F.exists(c["bases"], lambda b: is_category(b, known)),
            F.array_append(acc, F.struct(c["name"].alias("name"), c["seq"].alias("seq"))),
        ).otherwise(acc)

    return F.aggregate(F.filter(defs, lambda d: d["kind"] == "class"), empty, add)


def _candidate(detector: int, d: Column, rank: int, idx: Column, *, name, origin, line, evidence,
               origins=None, scope="function", param=None, function=None, message=None) -> Column:
    order = (
        F.lit(detector << 60)
        + F.shiftleft(d["seq"].cast("bigint"), 28)
        + F.lit(rank << 24) + idx.cast("bigint")
    )
    null = F.lit(None).cast("string")
    return F.struct(
        name.alias("qualified_name"), F.lit(origin).alias("origin"), line.alias("line"),
        evidence.alias("raw_evidence"),
        F.array(*map(F.lit, origins or [origin])).alias("origins"),
        (F.lit(scope) if isinstance(scope, str) else scope).alias("scope"),
        (null if param is None else param).alias("param_name"),
        (name if function is None else function).alias("function_name"),
        (null if message is None else message).alias("message"),
        order.alias("ord"),
    ).cast(CANDIDATE)


def _none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def _member(name: Column, param: Column) -> Column:
    return F.concat(name, F.lit("::"), param)


def decorator_rule(d: Column, name: Column) -> Column:
    """Decorators: their name, never their message, decides whether a parameter is meant."""
    rank = F.when(d["kind"] == "class", 1).otherwise(0)

    def rows(dec, i):
        keyword = F.get(F.filter(dec["keywords"], lambda k: k["arg"].isin(fixed.PARAM_KEYWORDS)), F.lit(0))
        first = F.get(dec["strings"], F.lit(0))
        shown = F.when(first.isNotNull(), F.concat(F.lit("("), first["quoted"], F.lit(")"))).otherwise(F.lit(""))
        by_keyword = F.concat(F.lit("("), keyword["arg"], F.lit("="), keyword["quoted"], F.lit(")"))
        param = F.coalesce(keyword["text"], first["text"], F.lit("kwarg"))
        at = F.concat(F.lit("@"), dec["name"])
        of_param = _candidate(
            0, d, 0, i, name=_member(name, param), origin="decorator", line=d["line"],
            evidence=F.concat(at, F.when(keyword.isNotNull(), by_keyword).otherwise(shown),
                              F.lit(" (parameter: '"), param, F.lit("')")),
            scope="parameter", param=param, function=name)
        of_function = _candidate(
            0, d, 0, i, name=name, origin="decorator", line=d["line"], evidence=F.concat(at, shown))
        return F.when(dec["name"].rlike(fixed.PARAM_DECORATOR), of_param).when(
            dec["name"].rlike(DEPRECATION), of_function)

    found = F.filter(F.transform(d["decorators"], rows), lambda c: c.isNotNull())
    # on a class the docstring comes before the decorators
    return F.transform(found, lambda c: c.withField("ord", c["ord"] + F.shiftleft(rank.cast("bigint"), 24)))


def docstring_rule(d: Column, name: Column) -> Column:
    c = _candidate(0, d, 1, F.lit(0), name=name, origin="docstring", line=d["line"],
                   evidence=matching_paragraphs(d["doc"]))
    c = c.withField("ord", c["ord"] - F.when(d["kind"] == "class", F.lit(1 << 24)).otherwise(F.lit(0)))
    return F.when(d["doc"].rlike(DEPRECATION), F.array(c)).otherwise(_none())


def _guard_params(guard: Column, d: Column) -> Column:
    """Parameters that an ``if`` test mentions, directly or as keyword strings."""
    strings = F.transform(F.filter(guard["tokens"], lambda t: t["kind"] == "string"), lambda t: t["text"])
    named = F.transform(
        guard["tokens"],
        lambda t: F.when(~F.array_contains(d["params"], t["text"]), F.array().cast("array<string>"))
        .when((t["kind"] == "name") & t["text"].eqNullSafe(d["kwarg"]), strings)
        .otherwise(F.array(t["text"])),
    )
    return F.array_distinct(F.flatten(named))


def warning_rule(d: Column, name: Column, local: Column) -> Column:
    """Warning calls; the innermost ``if`` that mentions parameters scopes them."""

    def rows(w, i):
        by_name = F.try_element_at(F.filter(w["idents"], lambda x: is_category(x, local)), F.lit(-1))
        category = F.coalesce(F.when(is_category(w["category"], local), w["category"]), by_name)
        message = F.coalesce(w["message"]["text"], w["first_arg"]["text"], F.lit(""))
        quoted = F.coalesce(w["message"]["quoted"], w["first_arg"]["quoted"], F.lit("''"))
        call = F.concat(
            F.lit("warnings.warn("), quoted,
            F.coalesce(F.concat(F.lit(", category="), category), F.lit("")), F.lit(")"))
        guard = F.get(F.filter(w["guards"], lambda g: F.size(_guard_params(g, d)) > 0), F.lit(0))
        params = _guard_params(guard, d)
        together = (F.size(params) > 1) & (guard["top_and"] | (guard["has_and"] & ~guard["has_or"]))
        params = F.when(together, F.array(F.array_join(F.array_sort(params), "+"))).otherwise(params)
        shown = F.when(guard["negated"], F.concat(F.lit("else: not ("), guard["test"], F.lit(")"))).otherwise(
            guard["test"])
        scoped = F.transform(
            params,
            lambda p, j: _candidate(
                0, d, 2, F.lit(0), name=_member(name, p), origin="warning", line=w["line"],
                evidence=F.concat(call, F.lit(" conditioned on param '"), p, F.lit("' (if "), shown, F.lit(")")),
                scope="parameter", param=p, function=name))
        plain = F.array(_candidate(0, d, 2, F.lit(0), name=name, origin="warning", line=w["line"], evidence=call))
        hit = category.isNotNull() | message.rlike(DEPRECATION)
        return F.when(~hit, _none()).when(guard.isNull(), plain).otherwise(scoped)

    # the place in the list is the order, however many warnings and parameters there are
    return F.transform(F.flatten(F.transform(d["warns"], rows)), lambda c, k: c.withField("ord", c["ord"] + k.cast("bigint")))


def assignment_rule(d: Column, name: Column) -> Column:
    """``name = deprecate(...)`` wrappers."""
    c = _candidate(0, d, 0, F.lit(0), name=name, origin="decorator", line=d["line"],
                   evidence=F.concat(d["name"], F.lit(" = "), d["callee"], F.lit("(...)")), message=d["message"])
    return F.when((d["kind"] == "assign") & d["callee"].rlike(DEPRECATION), F.array(c)).otherwise(_none())


def comment_rule(d: Column, name: Column) -> Column:
    """Comments just above, on the header of, or leading the body of a definition."""
    with_comment = F.transform(d["comments"], lambda c: c["line"])
    plain_code = F.array_except(d["code_lines"], with_comment)
    above = F.filter(
        d["comments"],
        lambda c: (c["line"] < d["first_line"]) & ~F.exists(plain_code, lambda n: n > c["line"]))
    beside = F.filter(
        d["comments"],
        lambda c: (c["line"] >= d["first_line"])
        & ((c["line"] <= d["line"]) | (c["line"] < d["body_line"])))
    found = F.filter(
        F.concat(F.reverse(above), beside),
        lambda c: c["text"].rlike(fixed.COMMENT_DEPRECATION) & ~c["text"].rlike(fixed.COMMENT_NEGATION))
    c = _candidate(1, d, 0, F.lit(0), name=name, origin="comment", line=F.get(found, F.lit(0))["line"],
                   evidence=F.array_join(F.transform(found, lambda x: strip(x["text"])), " ; "))
    return F.when(d["direct"] & (F.size(found) > 0), F.array(c)).otherwise(_none())


def declared_rule(d: Column, name: Column) -> Column:
    """Declared ``@deprecated`` members of modules and classes."""
    marks = F.filter(d["decorators"], lambda x: x["path"].isin(fixed.DECLARED_DECORATORS))
    message = F.get(F.get(marks, F.lit(0))["strings"], F.lit(0))
    c = _candidate(
        3, d, 0, F.lit(0), name=name, origin="pep702:griffe", line=d["first_line"],
        evidence=F.concat(F.lit("@warnings.deprecated("), message["quoted"], F.lit(")")),
        origins=["pep702", "pep702:griffe"],
        scope=F.when(d["kind"] == "class", F.lit("class")).otherwise(F.lit("function")),
        message=message["text"])
    return F.when(message.isNotNull() & ~d["in_function"] & ~d["superseded"], F.array(c)).otherwise(_none())


def find_candidates(files: DataFrame, detectors=DETECTORS, recount_parameters: bool = False) -> DataFrame:
    """Candidates of all detectors for ``file, prefix, source`` rows.

    Parameter hits are part of the legacy rules already. ``recount_parameters`` adds
    them once more, as the published raw totals do.
    """
    keep = [c for c in files.columns if c not in ("source", "prefix")]
    parsed = files.withColumn("defs", definitions("source"))
    # explode_outer: for explode the optimizer infers a filter on the array, pushes it
    # below the parse and parses twice
    parsed = parsed.select(*keep, "prefix", "defs", local_warning_classes(F.col("defs")).alias("local"))
    rows = parsed.select(*keep, "prefix", "local", F.explode_outer("defs").alias("d")).where(F.col("d").isNotNull())
    d = F.col("d")
    name = F.when(F.coalesce(F.col("prefix"), F.lit("")) == "", d["local_name"]).otherwise(
        F.concat_ws(".", "prefix", d["local_name"]))
    rows = rows.select(
        *keep, d, name.alias("name"),
        F.transform(F.filter("local", lambda x: x["seq"] < d["seq"]), lambda x: x["name"]).alias("local"))
    name, local = F.col("name"), F.col("local")
    legacy = F.concat(decorator_rule(d, name), docstring_rule(d, name), warning_rule(d, name, local),
                      assignment_rule(d, name))
    again = F.transform(
        F.filter(legacy, lambda c: c["scope"] == "parameter"),
        lambda c: c.withField("ord", c["ord"] + F.lit(2 << 60)))
    chosen = []
    if "legacy" in detectors:
        chosen.append(legacy)
    if "comment" in detectors:
        chosen.append(comment_rule(d, name))
    if "parameter" in detectors and (recount_parameters or "legacy" not in detectors):
        chosen.append(again)
    if "declared" in detectors:
        chosen.append(declared_rule(d, name))
    found = rows.select(*keep, F.explode(F.concat(*chosen)).alias("c"))
    return found.select(*keep, "c.*", (F.shiftright("c.ord", 60)).alias("detector"))


def find_parameters(files: DataFrame) -> DataFrame:
    """Only the parameter-scoped candidates."""
    return find_candidates(files, ("parameter",))


def find_declared(files: DataFrame) -> DataFrame:
    return find_candidates(files, ("declared",))


def find_comments(files: DataFrame) -> DataFrame:
    return find_candidates(files, ("comment",))
