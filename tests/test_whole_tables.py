"""Registered queries read every row of their tables."""

import pytest

from lodestone import plans
from lodestone.session import table

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["read_tables", "write_tables"])
def test_every_part(name, spark):
    part = {r["p_partkey"]: (r["p_name"], r["p_brand"]) for r in table(spark, LARGER, "part").collect()}
    got = {r["doc"]: r for r in plans.queries()[name](spark, LARGER).collect()}
    assert len(part) > 201 and got.keys() == part.keys()
    for doc, (title, brand) in part.items():
        if name == "read_tables":
            assert got[doc]["cells"] == f"{title},{brand}"
        else:
            assert got[doc]["text"].endswith(f"| {title} | {brand} |")
