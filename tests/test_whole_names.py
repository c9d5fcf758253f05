"""near_names keeps pairs whose grams many names hold."""

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import SF

from lodestone import plans


def test_near_names_of_a_common_gram(spark, tmp_path):
    part = pq.read_table(f"{SF}/part.parquet").slice(0, 60)
    names = ["".join(chr(97 + (i * k + k) % 26) for k in (1, 3, 5, 7, 9)) + f"{i:02d}xyzw" for i in range(60)]
    names[:2] = ["abqxyzw", "abjxyzw"]
    pq.write_table(part.set_column(part.schema.get_field_index("p_name"), "p_name", pa.array(names)), tmp_path / "part.parquet")
    got = plans.queries()["near_names"](spark, str(tmp_path)).collect()
    assert any({"abqxyzw", "abjxyzw"} <= {str(v) for v in r.asDict().values()} for r in got)
