"""Dotted symbol names: parts, compatibility, and the join keys that express it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(name: Column) -> Column:
    return F.split(name, "[.]")


def leaf(name: Column) -> Column:
    return F.element_at(parts(name), -1)


def root(name: Column) -> Column:
    return F.element_at(parts(name), 1)


def parent(name: Column) -> Column:
    return F.try_element_at(parts(name), F.lit(-2))


def in_class(name: Column) -> Column:
    """True when the part before the last one looks like a class."""
    return F.coalesce(parent(name).rlike(r"^\p{Lu}"), F.lit(False))


def compatible(a: Column, b: Column) -> Column:
    """True when two dotted names can denote the same API.

    The predicate is symmetric and holds only for names with the same leaf.
    """
    n_a, n_b = F.size(parts(a)), F.size(parts(b))
    shorter = F.when(n_a < n_b, a).otherwise(b)
    longer = F.when(n_a < n_b, b).otherwise(a)
    suffix = F.endswith(longer, F.concat(F.lit("."), shorter))
    bare_method = (F.size(parts(shorter)) == 1) & in_class(longer)
    cls_a, cls_b = parent(a), parent(b)
    frames = ["DataFrame", "Series"]
    same_class = (cls_a == cls_b) | (
        (root(a) == "pandas")
        & ((cls_a.isin(frames) & (cls_b == "NDFrame")) | (cls_b.isin(frames) & (cls_a == "NDFrame")))
    )
    second = lambda c: F.try_element_at(parts(c), F.lit(2))
    same_package = (n_a >= 3) & (n_b >= 3) & (second(a) == second(b))
    re_export = ((n_a == 2) | (n_b == 2)) & ~in_class(a) & ~in_class(b)
    rule = (
        F.when(a == b, True)
        .when(suffix, ~bare_method)
        .when((root(a) != root(b)) | (leaf(a) != leaf(b)), False)
        .when(in_class(a) & in_class(b), same_class)
        .otherwise(same_package | re_export)
    )
    return F.coalesce(rule, F.lit(False))


def _tail(name: Column, bare_methods: bool) -> Column:
    """Proper dotted suffixes; by default the bare leaf only where it is not a method."""
    p = parts(name)
    n = F.size(p)
    tails = F.when(
        n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(p, i, n - i + 1), "."))
    ).otherwise(F.array().cast("array<string>"))
    if bare_methods:
        return tails
    return F.when(in_class(name), F.slice(tails, 1, F.greatest(n - 2, F.lit(0)))).otherwise(tails)


def _keys(*choices) -> Column:
    """Array of the keys whose condition holds."""
    return F.filter(F.array(*[F.when(cond, F.concat_ws("\x1f", *[F.lit(x) if isinstance(x, str) else x for x in key]))
                              for cond, key in choices]), lambda k: k.isNotNull())


def _prefixed(tag: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat_ws("\x1f", F.lit(tag), x))


def build_keys(name: Column, bare_methods: bool = False) -> Column:
    """Keys under which a catalog name is filed.

    ``build_keys(a)`` and ``probe_keys(b)`` have an element in common exactly when
    ``compatible(a, b)``. A match is then an equi-join on single keys, and each key
    needs only its first catalog name, so no pairs within a hot leaf are formed.
    ``bare_methods`` also lets a method meet its bare name.
    """
    p, n = parts(name), F.size(parts(name))
    method, lf, rt = in_class(name), leaf(name), root(name)
    second = F.try_element_at(p, F.lit(2))
    return F.concat(
        _keys(
            (F.lit(True), ("whole", name)),
            (method, ("class", rt, parent(name), lf)),
            ((n >= 3) & method, ("package", rt, second, lf, "method")),
            ((n >= 3) & ~method, ("package", rt, second, lf, "function")),
            ((n == 2) & ~method, ("short", rt, lf)),
            ((n >= 2) & ~method, ("any", rt, lf)),
        ),
        _prefixed("tail", _tail(name, bare_methods)),
    )


def probe_keys(name: Column, bare_methods: bool = False) -> Column:
    """Keys under which a symbol looks for its catalog names."""
    p, n = parts(name), F.size(parts(name))
    method, lf, rt, cls = in_class(name), leaf(name), root(name), parent(name)
    second = F.try_element_at(p, F.lit(2))
    frame = method & (rt == "pandas")
    return F.concat(
        _keys(
            (F.lit(True), ("whole", name)),
            (F.lit(True), ("tail", name)),
            (method, ("class", rt, cls, lf)),
            (frame & cls.isin("DataFrame", "Series"), ("class", rt, "NDFrame", lf)),
            (frame & (cls == "NDFrame"), ("class", rt, "DataFrame", lf)),
            (frame & (cls == "NDFrame"), ("class", rt, "Series", lf)),
            # two methods meet only through their classes
            (n >= 3, ("package", rt, second, lf, "function")),
            ((n >= 3) & ~method, ("package", rt, second, lf, "method")),
            ((n >= 2) & ~method, ("short", rt, lf)),
            ((n == 2) & ~method, ("any", rt, lf)),
        ),
        _prefixed("whole", _tail(name, bare_methods)),
    )
