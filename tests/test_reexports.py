"""Names followed through the modules of a library."""

from wane.operators import reexports as rex

FILES = {
    "lib/__init__.py": "from .core import *\nfrom . import sub as part\nimport os\nfrom .missing import gone\nfrom .a import loop\nfrom ._api import _hidden, Frame\nalias = part.deep\n",
    "lib/core/__init__.py": "from .impl import *\n__all__ = ['f', 'g']\nfrom .impl import g\n",
    "lib/core/impl.py": "def f(): pass\ndef g(): pass\ndef h(): pass\ndef _private(): pass\n",
    "lib/sub/__init__.py": "from ..core.impl import h as deep\n",
    "lib/a.py": "from .b import loop\n",
    "lib/b.py": "from lib.a import loop\nfrom lib import part as back\n",
    "lib/_api.py": "from .frame import Frame\ndef _hidden(): pass\ndef read(path) -> Frame: pass\ndef either() -> 'Frame | None': pass\ndef opt() -> Optional[Frame]: pass\ndef num() -> int: pass\n",
    "lib/frame.py": "class Frame:\n    def head(self) -> 'Frame': pass\n    def me(self) -> Self: pass\n",
    "lib/broken.py": "def (:\n",
}


def names(spark, files=FILES, by=()):
    rows = [(f, f[:-3].replace("/", ".").removesuffix(".__init__"), s, "1.0") for f, s in files.items()]
    return rex.library_names(spark.createDataFrame(rows, "file string, prefix string, source string, version string"), list(by))


def test_chains_stars_modules_and_circles(spark):
    got = {r.from_symbol: (r.to_symbol, r.kind) for r in rex.re_exports(names(spark)).collect()}
    assert got["lib.f"] == ("lib.core.impl.f", "defined") and got["lib.g"] == ("lib.core.impl.g", "defined")
    assert "lib.h" not in got and "lib._private" not in got and "lib.core._private" not in got
    assert got["lib.part"] == ("lib.sub", "module") and got["lib.os"] == ("os", "outside")
    assert got["lib.gone"] == ("lib.missing.gone", "outside") and got["lib.loop"] == (None, "cycle") == got["lib.a.loop"]
    assert got["lib.alias"] == ("lib.core.impl.h", "defined") == got["lib.sub.deep"]
    assert got["lib.b.back"] == ("lib.sub", "module") and got["lib._hidden"] == ("lib._api._hidden", "defined")


def test_trees_do_not_mix_and_empty_trees_end(spark):
    two = names(spark, by=["version"]).unionByName(names(spark, {"lib/__init__.py": "from .core import f\n", "lib/core.py": "def f(): pass\n"}))
    got = {(r.tree, r.from_symbol): r.to_symbol for r in rex.re_exports(two).collect()}
    assert got["1.0", "lib.f"] == "lib.core.impl.f" and got["", "lib.f"] == "lib.core.f"
    assert rex.re_exports(names(spark).limit(0)).count() == 0


def test_annotated_returns_name_the_defining_class(spark):
    n = names(spark)
    got = {(r.function, r.made) for r in rex.returned(n, rex.re_exports(n)).collect()}
    frame = "lib.frame.Frame"
    assert got == {(f"lib._api.{f}", frame) for f in ("read", "either", "opt")} | {(f"{frame}.head", frame), (f"{frame}.me", frame)}


def test_calls_of_what_functions_return(spark):
    from pyspark.sql import functions as F

    from wane.operators.resolution import call_statuses

    n = names(spark)
    exports = rex.re_exports(n)
    code = "from lib import _api as api, Frame\nx = api.read('p').head()\nx.old()\nFrame().old()\napi.num().old()\n"
    df = spark.createDataFrame([("s", code)], "sample_id string, function string")
    catalog = spark.createDataFrame([("lib.frame.Frame.old",)], "qualified_name string")
    rows = call_statuses(df, catalog, F.lit(""), carry=["sample_id"], aliases=exports, returns=rex.returned(n, exports)).collect()
    by = {r.client_line: (r.status, r.qualified_name) for r in rows}
    old = ("resolved_deprecated", "lib.frame.Frame.old")
    assert by == {3: old, 4: old, 5: ("low_confidence", None)}
