"""Queries of the source graph: sources made of the columns of part, one file of each language a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import symbols as G
from lodestone.plans.blocks import _made, _sql
from lodestone.session import table

#: {name} stands for a column of part.
SOURCES = {
    "rs": "// fn no()\npub fn run_{p_partkey}(x: Item) -> Out {\n    call_me(x)\n}\npub struct Widget{p_size} {\nimpl Show for Widget{p_size} {\nuse crate::deep::*;\nuse std::fmt as f;\n",
    "py": "import os.path as p\nfrom abc import ABC\nclass Thing{p_size}(ABC):\n    def go_{p_partkey}(self):\n        # note()\n        return helper(self)\n",
    "ts": "import { A } from './a'\nexport class Box{p_size} extends Base implements Shape {\ninterface Shape {\nconst make = (x) => x\n",
    "go": 'package main\nimport "fmt"\nfunc (b *Box) Open{p_partkey}() error {\ntype Box struct {\n\tfmt.Println(x)\n',
    "txt": "fn nothing() {}\n",
}
#: (ending, line, role, kind, name, other) of every source.
ROWS = [
    ("rs", 2, "definition", "fn", "run_{p_partkey}", None), ("rs", 2, "reference", "type", "Item", None), ("rs", 2, "reference", "type", "Out", None), ("rs", 3, "reference", "call", "call_me", None),
    ("rs", 5, "definition", "struct", "Widget{p_size}", None), ("rs", 5, "reference", "type", "Widget{p_size}", None), ("rs", 6, "implementation", "implementation", "Widget{p_size}", "Show"),
    ("rs", 6, "reference", "type", "Show", None), ("rs", 6, "reference", "type", "Widget{p_size}", None), ("rs", 7, "import", "wildcard", "crate::deep::*", None), ("rs", 8, "import", "import", "std::fmt", "f"),
    ("py", 1, "import", "import", "os.path", "p"), ("py", 2, "import", "import", "abc", None), ("py", 2, "reference", "type", "ABC", None), ("py", 3, "definition", "class", "Thing{p_size}", None),
    ("py", 3, "implementation", "implementation", "Thing{p_size}", "ABC"), ("py", 3, "reference", "type", "Thing{p_size}", None), ("py", 3, "reference", "type", "ABC", None), ("py", 4, "definition", "def", "go_{p_partkey}", None), ("py", 6, "reference", "call", "helper", None),
    ("ts", 1, "import", "import", "./a", None), ("ts", 1, "reference", "type", "A", None), ("ts", 2, "definition", "class", "Box{p_size}", None), ("ts", 2, "implementation", "implementation", "Box{p_size}", "Base"), ("ts", 2, "implementation", "implementation", "Box{p_size}", "Shape"),
    ("ts", 2, "reference", "type", "Box{p_size}", None), ("ts", 2, "reference", "type", "Base", None), ("ts", 2, "reference", "type", "Shape", None), ("ts", 3, "definition", "interface", "Shape", None), ("ts", 3, "reference", "type", "Shape", None), ("ts", 4, "definition", "function", "make", None),
    ("go", 2, "import", "import", "fmt", None), ("go", 3, "definition", "func", "Open{p_partkey}", None), ("go", 3, "reference", "type", "Box", None), ("go", 3, "reference", "type", "Open{p_partkey}", None), ("go", 4, "definition", "type", "Box", None), ("go", 4, "reference", "type", "Box", None), ("go", 5, "reference", "type", "Println", None),
]


def _files(spark, sf) -> DataFrame:
    parts = [_made(spark, sf, text).select(F.concat(F.lit("src/"), F.col("doc").cast("string"), F.lit("." + end)).alias("path"), F.col("text").alias("content")) for end, text in SOURCES.items()]
    return reduce(DataFrame.unionByName, parts)


def _graph(spark, sf) -> DataFrame:
    return G.parse(_files(spark, sf))


def _events(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "deleted").otherwise("modified")
    return part.filter("p_partkey % 3 < 2").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), kind.alias("change"))


def _changed(spark, sf) -> DataFrame:
    """The graph after a third of the Python files went and a third became the same text twice, shifted by a line."""
    files = _files(spark, sf).withColumn("content", F.concat(F.lit("\n"), "content"))
    return G.statistics(G.change(_graph(spark, sf), files, _events(spark, sf)))


def _oracle_rows() -> str:
    rows = []
    for end, line, role, kind, name, other in ROWS:
        rows.append(f"SELECT p_partkey AS k, 'src/' || p_partkey || '.{end}' AS path, CAST({line} AS INTEGER) AS line, '{role}' AS role, '{kind}' AS kind, {_sql(name)} AS name, {'CAST(NULL AS VARCHAR)' if other is None else _sql(other)} AS other FROM part")
    return " UNION ALL ".join(rows)


_R = f"r AS ({_oracle_rows()})"
_COUNTS = "count(DISTINCT path) AS files, count(*) FILTER (role = 'definition') AS definitions, count(*) FILTER (role = 'reference') AS \"references\", count(*) FILTER (role = 'import') AS imports, count(*) FILTER (role = 'implementation') AS implementations"

QUERIES = {
    "source_symbols": lambda s, d: _graph(s, d),
    "source_statistics": lambda s, d: G.statistics(_graph(s, d)),
    "source_references": lambda s, d: G.references(_graph(s, d), "Shape").select("path", "line", "kind"),
    "source_definitions": lambda s, d: G.definitions(_graph(s, d), "Widget7").select("path", "line", "kind"),
    "source_outline": lambda s, d: G.outline(_graph(s, d)),
    "source_change": _changed,
}
ORACLE = {
    "source_symbols": f"WITH {_R} SELECT path, line, role, kind, name, other FROM r",
    "source_statistics": f"WITH {_R} SELECT {_COUNTS} FROM r",
    "source_references": f"WITH {_R} SELECT path, line, kind FROM r WHERE role = 'reference' AND name = 'Shape'",
    "source_definitions": f"WITH {_R} SELECT path, line, kind FROM r WHERE role = 'definition' AND name = 'Widget7'",
    "source_outline": f"WITH {_R} SELECT path, kind, name, line AS first, CAST(lead(line) OVER (PARTITION BY path ORDER BY line) - 1 AS INTEGER) AS last FROM r WHERE role = 'definition'",
    "source_change": f"WITH {_R} SELECT {_COUNTS} FROM r WHERE NOT (path LIKE '%.py' AND k % 3 = 0)",
}
