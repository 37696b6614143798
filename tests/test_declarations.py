from textwrap import dedent

from wane.operators.declarations import find_candidates, find_comments, find_declared, find_parameters


def run(spark, code, prefix="", finder=find_candidates):
    df = spark.createDataFrame([("m.py", prefix, dedent(code))], "file string, prefix string, source string")
    return finder(df).orderBy("ord").collect()


def test_one_candidate_per_channel(spark):
    rows = run(spark, '''
        import warnings
        def deprecated(msg): pass
        @deprecated("gone")
        def a(): pass
        def b():
            warnings.warn("old", DeprecationWarning)
        def c():
            """Text.

            .. deprecated:: 1.2
               use d
            """
        def d():
            """fine"""
    ''', "pkg")
    assert [(r.qualified_name, r.origin) for r in rows] == [("pkg.a", "decorator"), ("pkg.b", "warning"), ("pkg.c", "docstring")]
    assert rows[0].raw_evidence == "@deprecated('gone')"
    assert rows[1].raw_evidence == "warnings.warn('old', category=DeprecationWarning)"
    assert rows[2].raw_evidence == ".. deprecated:: 1.2 use d"


def test_class_and_method_names(spark):
    rows = run(spark, '''
        class C:
            """Deprecated class."""
            def m(self):
                warn("m is deprecated")
    ''', "lib")
    assert [(r.qualified_name, r.origin) for r in rows] == [("lib.C", "docstring"), ("lib.C.m", "warning")]


def test_other_categories_are_ignored(spark):
    assert run(spark, 'def f():\n    warnings.warn("careful", UserWarning)\n') == []


def test_local_warning_classes_follow_source_order(spark):
    rows = run(spark, '''
        def early():
            warnings.warn("x", Leaf)
        class Base(DeprecationWarning): pass
        class Leaf(Base): pass
        def late():
            warnings.warn("x", Leaf)
        def third():
            warnings.warn("x", category=np.Pandas4Warning)
    ''')
    assert [r.qualified_name for r in rows] == ["late", "third"]
    assert "category=Leaf" in rows[0].raw_evidence


def test_guarded_warnings_are_about_parameters(spark):
    rows = run(spark, '''
        def f(a, old=None):
            if old is not None:
                warnings.warn("m", FutureWarning)
        def g(**kwargs):
            if "k" in kwargs:
                warnings.warn("m", FutureWarning)
        def h(x, flag):
            if GLOBAL:
                warnings.warn("m", FutureWarning)
        def e(p):
            if p:
                pass
            else:
                warnings.warn("m", FutureWarning)
    ''')
    assert [r.qualified_name for r in rows] == ["f::old", "g::k", "h", "e::p"]
    assert rows[0].raw_evidence.endswith("conditioned on param 'old' (if old is not None)")
    assert [r.scope for r in rows] == ["parameter", "parameter", "function", "parameter"]
    assert "else: not (p)" in rows[3].raw_evidence


def test_and_joins_or_separates(spark):
    rows = run(spark, '''
        def f(b, a):
            if b and a:
                warnings.warn("m", FutureWarning)
        def g(a, b):
            if a or b:
                warnings.warn("m", FutureWarning)
    ''')
    assert [r.qualified_name for r in rows] == ["f::a+b", "g::a", "g::b"]


def test_inner_guard_and_nested_definitions(spark):
    rows = run(spark, '''
        def f(a, b):
            if a:
                if SWITCH:
                    warnings.warn("m", FutureWarning)
            def inner():
                warnings.warn("m", FutureWarning)
    ''')
    assert [r.qualified_name for r in rows] == ["f::a", "f.inner"]


def test_decorator_names_decide_scope(spark):
    rows = run(spark, '''
        @deprecate_kwarg("old", "new")
        def f(new): pass
        @deprecate_kwarg(new_arg_name="n", old_arg_name="o")
        def g(n): pass
        @deprecated("argument x is obsolete")
        def h(x): pass
        old = np.deprecate(h, message="use h")
    ''')
    assert [(r.qualified_name, r.scope) for r in rows] == [
        ("f::old", "parameter"), ("g::o", "parameter"), ("h", "function"), ("old", "function")]
    assert rows[1].raw_evidence == "@deprecate_kwarg(old_arg_name='o') (parameter: 'o')"
    assert rows[3].message == "use h" and rows[3].raw_evidence == "old = np.deprecate(...)"


def test_comments(spark):
    rows = run(spark, '''
        # Deprecated: use y
        def x(): pass

        def y():  # deprecated since 2
            pass

        # Not deprecated
        def z(): pass

        # plain
        def w():
            # leading deprecation note
            return 1

        # deprecated but not attached
        v = 1
        def u(): pass
    ''', finder=find_comments)
    assert [(r.qualified_name, r.line) for r in rows] == [("x", 2), ("y", 5), ("w", 13)]
    assert rows[0].raw_evidence == "# Deprecated: use y"


def test_declared(spark):
    code = '''
import warnings
from typing_extensions import deprecated

@deprecated("use new_foo() instead")
def old_foo():
    pass

@warnings.deprecated("use new_calc() instead", category=None)
def old_calc():
    pass

class P:
    @deprecated("use compute() instead")
    def process(self):
        pass

@deprecated("gone")
class Q:
    pass
'''
    rows = run(spark, code, "my.sub", find_declared)
    assert [(r.qualified_name, r.line, r.scope) for r in rows] == [
        ("my.sub.old_foo", 5, "function"), ("my.sub.old_calc", 9, "function"), ("my.sub.P.process", 14, "function"),
        ("my.sub.Q", 18, "class")]
    assert rows[1].message == "use new_calc() instead" and rows[0].origins == ["pep702", "pep702:griffe"]
    assert rows[0].raw_evidence == "@warnings.deprecated('use new_foo() instead')"


def test_unrelated_decorator_of_the_same_name_is_not_declared(spark):
    assert run(spark, 'def deprecated(m): pass\n@deprecated("x")\ndef f(): pass\n', finder=find_declared) == []


def test_parameters_only_and_recount(spark):
    code = 'def f(a):\n    if a:\n        warnings.warn("x", FutureWarning)\n    warnings.warn("y", FutureWarning)\n'
    assert [r.qualified_name for r in run(spark, code, finder=find_parameters)] == ["f::a"]
    rows = run(spark, code, finder=lambda d: find_candidates(d, recount_parameters=True))
    assert [(r.qualified_name, r.detector) for r in rows] == [("f::a", 0), ("f", 0), ("f::a", 2)]


def test_broken_source_gives_no_rows(spark):
    assert run(spark, "def broken(:") == []
    assert run(spark, None or "") == []


def test_one_python_pass(spark):
    df = spark.createDataFrame([("m.py", "", "x")], "file string, prefix string, source string")
    plan = find_candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
