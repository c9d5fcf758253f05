"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Sizes are words. The sources, by code point with null last, weigh ``weights`` in turn and
share ``budget`` times all sizes; a target stops at ``max_copies`` times its source's size
and what it leaves is shared by weight among the others until none is above. A document's
expected copies are target / source size. The whole part is taken for sure; the rest is a
probability, and probabilities are rounded in pairs: of two documents, mass moves from one
to the other (in proportion to their sizes, so that the expected words stay the same) in a
random direction until one of them is 0 or 1. The survivor meets the next document. Blocks
of a bounded number of documents are folded in parallel, each leaves at most one document
undecided, and these meet in the next level, ``fan_in`` blocks at a time: a reduction tree
per source. The words taken from a source end within half a document's size of its target: the one document that is left
undecided at the root goes to the nearer end.

Defined results: a null or empty text has size 0 and takes 0 words; null sources are a
source; repeated rows are rounded one by one; an empty table gives an empty result. A
source whose documents are all empty has target 0. Randomness is a hash of ids and seed,
so reruns agree whatever the partitioning. A hot source is split among its blocks before
anything is gathered, so no task holds more than a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, checkpointed, free, read

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_COPIES = 2
#: Documents of a block at the first level, and blocks that meet at each further one.
BLOCK = 128
FAN_IN = 64


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint"))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, source_rows, target.

    The shares are found in closed form: with the sources ordered by cap / weight, those
    before a point are capped and the rest get weight times what is left per weight; the
    first source whose cap holds that much ends the capped ones. The ordered window runs
    over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("cap", F.col("source_size") * float(max_copies))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left / left_weight)
    per = per.withColumn("free", F.col("cap") >= F.col("share") * F.col("weight"))
    first_free = F.first(F.when(F.col("free"), F.col("share")), ignorenulls=True).over(whole)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * first_free, F.col("cap")))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


ITEM = "struct<key:bigint,doc_id:bigint,dup:bigint,size:bigint,p:double>"

_FOLD = """
aggregate(
  items,
  cast(struct(array() as done, null as open) as struct<done:array<{item}>,open:{item}>),
  (acc, x) -> if(acc.open is null, struct(acc.done as done, x as open),
    element_at(transform(array(struct(
        x.size / acc.open.size as ratio,
        (xxhash64(acc.open.key, acc.open.doc_id, acc.open.dup, x.key, x.doc_id, x.dup, {seed}L) & {mask}L) / {mask_1}D as u)), z ->
    element_at(transform(array(struct(
        least(1D - acc.open.p, x.p * z.ratio) as up,
        least(acc.open.p, (1D - x.p) * z.ratio) as down,
        z.ratio as ratio, z.u as u)), y ->
    element_at(transform(array(if(y.u * (y.up + y.down) < y.down,
        struct(if(y.up >= 1D - acc.open.p, 1D, acc.open.p + y.up) as a, if(y.up >= x.p * y.ratio, 0D, x.p - y.up / y.ratio) as b),
        struct(if(y.down >= acc.open.p, 0D, acc.open.p - y.down) as a, if(y.down >= (1D - x.p) * y.ratio, 1D, x.p + y.down / y.ratio) as b))), q ->
    element_at(transform(array(struct(
        named_struct('key', acc.open.key, 'doc_id', acc.open.doc_id, 'dup', acc.open.dup, 'size', acc.open.size, 'p', q.a) as one,
        named_struct('key', x.key, 'doc_id', x.doc_id, 'dup', x.dup, 'size', x.size, 'p', q.b) as two)), s ->
      struct(
        concat(acc.done, if(s.one.p in (0D, 1D), array(s.one), array()), if(s.two.p in (0D, 1D), array(s.two), array())) as done,
        if(s.one.p not in (0D, 1D), s.one, if(s.two.p not in (0D, 1D), s.two, null)) as open)
    ), 1)), 1)), 1)), 1)))
"""


def _fold(seed: int) -> Column:
    return F.expr(_FOLD.format(item=ITEM, seed=seed, mask=2**53 - 1, mask_1=float(2**53)))


def pivotal(items: DataFrame, group: list[str], most: int, seed: int = 0, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Rounds p of every row to 0 or 1 within its group, keeping the group's sum of p * size.

    items: the group's columns and key, doc_id, dup, size > 0 (long), 0 < p < 1 (double); key,
    doc_id and dup tell the rows of a group apart. most: the rows of the largest group.
    Returns the group's columns with doc_id, dup, size and p.
    """
    blocks = max(1, math.ceil(most / block))
    level = items.withColumn("_b", F.pmod(F.xxhash64("key", "doc_id", "dup", F.lit(seed)), F.lit(blocks)))
    level = level.withColumn("_i", F.struct("key", "doc_id", "dup", "size", "p"))
    done = []
    while True:
        gathered = level.groupBy(*group, "_b").agg(F.sort_array(F.collect_list("_i")).alias("items"))
        folded = checkpointed(gathered.select(*group, "_b", _fold(seed + len(done)).alias("f")))
        done.append(folded.select(*group, F.explode("f.done").alias("_i")))
        level = folded.filter("f.open is not null").select(*group, F.expr(f"_b div {fan_in}").alias("_b"), F.col("f.open").alias("_i"))
        if blocks == 1:
            break
        blocks = math.ceil(blocks / fan_in)
    # one row per group is left; the nearer end keeps the group's sum closest
    last = F.struct("_i.key", "_i.doc_id", "_i.dup", "_i.size", F.when(F.col("_i.p") >= 0.5, 1.0).otherwise(0.0).alias("p"))
    done.append(level.select(*group, last.alias("_i")))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*group, "_i.*")


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, text_key, size, source_size, target, copies.

    text_key is a hash of the text; it keeps rows of a null or repeated doc_id apart.
    """
    sized = sizes(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("key"))
    # equal rows are counted first, so that no key can gather more than its count
    counted = checkpointed(sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")))
    single = counted.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("dup")).drop("n")
    per = checkpointed(targets(counted.select("source", (F.col("size") * F.col("n")).alias("size"), "n").groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).select("source", "size"), weights, budget, max_copies).drop("source_rows"))
    per = per.withColumnRenamed("source", "_source")
    rows = single.join(per, single.source.eqNullSafe(per._source)).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    sure = (F.col("size") == 0) | (F.col("p") <= 0)
    most = single.filter("size > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    group = ["source", "source_size", "target", "base"]
    rounded = pivotal(rows.filter(~sure), group, most, seed)
    cols = [*group, "key", "doc_id", "dup", "size"]
    fixed = rows.filter(sure).select(*cols, F.lit(0.0).alias("p"))
    out = rounded.select(*cols, "p").unionAll(fixed.select(*cols, "p"))
    copies = (F.col("base") + F.col("p")).cast("bigint")
    return out.select("doc_id", "source", F.col("key").alias("text_key"), "size", "source_size", "target", F.when(F.col("size") == 0, F.least(copies, F.lit(1).cast("bigint"))).otherwise(copies).alias("copies"))


def apply(docs: DataFrame, **settings) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    taken = mix(docs.select("doc_id", "source", "text"), **settings)
    taken = taken.groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = checkpointed(taken.filter("_copies > 0").toDF("_doc", "_source", "_key", "_copies", "_rows"))
    key, copies, turn = (free(docs.columns, n) for n in ("text_key", "copies", "turn"))
    taken = taken.withColumnRenamed("_copies", copies)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = [keyed[key].eqNullSafe(taken._key), keyed.doc_id.eqNullSafe(taken._doc), keyed.source.eqNullSafe(taken._source)]

    def times(rows: DataFrame, once: bool) -> DataFrame:
        met = keyed.join(rows, same)
        met = met.select(*[keyed[c] for c in docs.columns], copies)
        met = met if once else met.dropDuplicates(["doc_id", "source", "text"])
        return met.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop(turn, copies)

    out = times(taken.filter("_rows = 1"), True)
    again = taken.filter("_rows > 1")
    return out if again.isEmpty() else out.unionByName(times(again, False))


def op7_mixing(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
