"""Of line items that share document and place, the first in the table's order gives the type."""

import pyarrow as pa
import pyarrow.parquet as pq

from lodestone import plans


def test_first_row_counts(spark, tmp_path):
    def part(name, rows):
        order, line, key, flag = zip(*rows, strict=True)
        cols = {"l_orderkey": pa.array(order, pa.int64()), "l_linenumber": pa.array(line, pa.int32()), "l_partkey": pa.array(key, pa.int64()), "l_returnflag": pa.array(flag)}
        pq.write_table(pa.table(cols), tmp_path / "lineitem.parquet" / name)

    (tmp_path / "lineitem.parquet").mkdir()
    # 2 * 1,000,000 + 5 = 1 * 1,000,000 + 1,000,005; the second file is the larger one, which Spark takes first
    part("a.parquet", [(k, 2, 5, "A") for k in range(1, 6)])
    part("b.parquet", [(k, 1, 1_000_005, "R") for k in range(1, 6)] + [(k, 3, 1, "N") for k in range(1, 6)] + [(k, 1, 1, "R") for k in range(6, 2000)])
    got = {r["type"]: (r["inside"], r["n"], r["parents"]) for r in plans.queries()["regroup_rows"](spark, str(tmp_path)).collect()}
    assert got == {"table": (0, 5, None), "table_row": (5, 5, 5 * 2_000_005), "paragraph": (0, 1994, None)}
