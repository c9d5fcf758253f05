"""Keyword registries: groups of entries with ids, aliases and relations; checks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.2.0"


def from_csv(spark: SparkSession, path: str, group: str) -> DataFrame:
    """group, id, aliases, extra of a CSV with columns id and aliases (parted by |)."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if not {"id", "aliases"} <= set(rows.columns):
        raise ValueError("a registry needs the columns id and aliases")
    extra = [F.col(c) for c in rows.columns if c not in ("id", "aliases")]
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda a: a != "")
    id_ = F.when(F.coalesce(F.trim("id"), F.lit("")) != "", F.trim("id")).otherwise(F.raise_error(F.lit("blank id")))
    packed = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    return rows.select(F.lit(group).alias("group"), id_.alias("id"), aliases.alias("aliases"), packed.alias("extra"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """group, id, aliases, related, description of a registry document; versions before 1.2.0 read alike, later majors don't."""
    schema = "schemaVersion string, groups array<struct<id:string,entries:array<struct<id:string,aliases:array<string>,relatedIds:array<string>,description:string>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    late = F.split_part("schemaVersion", F.lit("."), F.lit(1)).try_cast("int") > 1
    doc = doc.withColumn("groups", F.when(late, F.raise_error(F.lit("a registry of a future version"))).otherwise(F.col("groups")))
    g = doc.select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group"), F.posexplode("g.entries").alias("pos", "e"))
    none = F.array().cast("array<string>")
    return g.select("group", "pos", "e.id", F.coalesce("e.aliases", none).alias("aliases"), F.coalesce("e.relatedIds", none).alias("related"), "e.description")


def repeated_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("group", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def broken_relations(entries: DataFrame) -> DataFrame:
    """id, related: relations to ids that no group has."""
    asked = entries.select("id", F.explode("related").alias("related"))
    return asked.join(entries.select(F.col("id").alias("related")).distinct(), "related", "left_anti")


def alias_collisions(entries: DataFrame) -> DataFrame:
    """alias, ids: aliases, trimmed and in lower case, that several entries have."""
    a = entries.select("id", F.explode("aliases").alias("alias")).select("id", F.lower(F.trim("alias")).alias("alias")).distinct()
    return a.groupBy("alias").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def alias_map(entries: DataFrame) -> DataFrame:
    """alias, id: the last entry that has an alias holds it."""
    a = entries.select("pos", "id", F.explode("aliases").alias("alias"))
    return a.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.max_by("id", F.struct("pos", "id")).alias("id"))


def group_statistics(entries: DataFrame) -> DataFrame:
    """group, entries, repeated (ids that repeat when case is aside), aliases."""
    return entries.groupBy("group").agg(F.count(F.lit(1)).alias("entries"), (F.count(F.lit(1)) - F.count_distinct(F.lower("id"))).alias("repeated"), F.sum(F.size("aliases")).cast("bigint").alias("aliases"))


def field_errors(entries: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """id, field, error for string columns against rules: required, pattern, enum, min, max."""
    found = []
    for name, r in rules.items():
        c = F.col(name)
        checks = [F.when(c.isNull(), F.lit("required"))] if r.get("required") else []
        if "pattern" in r:
            checks.append(F.when(~c.rlike(r["pattern"]), F.lit("pattern")))
        if "enum" in r:
            checks.append(F.when(~c.isin(*r["enum"]), F.lit("enum")))
        if "min" in r:
            checks.append(F.when(F.char_length(c) < r["min"], F.lit("short")))
        if "max" in r:
            checks.append(F.when(F.char_length(c) > r["max"], F.lit("long")))
        found.append(_tagged(name, checks))
    return entries.select("id", F.explode(F.flatten(F.array(*found))).alias("e")).select("id", "e.field", "e.error")


def _tagged(name: str, checks: list):
    return F.transform(F.array_compact(F.array(*checks)), lambda e: F.struct(F.lit(name).alias("field"), e.alias("error")))


def rule_proofs(rules: DataFrame) -> DataFrame:
    """id, proven of (id, pattern, accepted, rejected): both lists are there and every text agrees with the pattern."""
    texts = rules.select("id", "pattern", F.explode(F.concat(F.transform("accepted", lambda t: F.struct(t.alias("t"), F.lit(True).alias("y"))), F.transform("rejected", lambda t: F.struct(t.alias("t"), F.lit(False).alias("y"))))).alias("v"))
    ok = texts.groupBy("id").agg(F.bool_and(F.expr("v.t rlike pattern") == F.col("v.y")).alias("agree"))
    both = rules.select("id", ((F.size("accepted") > 0) & (F.size("rejected") > 0)).alias("both"))
    return both.join(ok, "id", "left").select("id", (F.col("both") & F.coalesce("agree", F.lit(False))).alias("proven"))


def to_markdown(entries: DataFrame) -> DataFrame:
    """group, text: a heading and a pipe table of each group's entries in order."""
    from lodestone.functions.text import cell

    line = F.concat(F.lit("| "), cell(F.col("id")), F.lit(" | "), cell(F.array_join("aliases", ", ")), F.lit(" |"))
    rows = entries.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("r"))
    head = F.concat(F.lit("## "), F.col("group"), F.lit("\n\n| id | aliases |\n| --- | --- |\n"))
    return rows.select("group", F.concat(head, F.array_join(F.transform("r", lambda x: x.l), "\n")).alias("text"))


def save(entries: DataFrame, path: str) -> None:
    """The registry as JSON lines, one group a line, under the current version; from_json reads groups of one document."""
    group = F.struct(F.col("group").alias("id"), F.transform("e", lambda x: F.struct(x.id.alias("id"), x.aliases.alias("aliases"), x.related.alias("relatedIds"), x.description.alias("description"))).alias("entries"))
    g = entries.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "aliases", "related", "description"))).alias("e"))
    g.select(F.lit(VERSION).alias("schemaVersion"), F.array(group).alias("groups")).write.mode("overwrite").json(path)


def load_saved(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry that save() wrote."""
    schema = "schemaVersion string, groups array<struct<id:string,entries:array<struct<id:string,aliases:array<string>,relatedIds:array<string>,description:string>>>>"
    g = spark.read.schema(schema).json(path).select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group"), F.posexplode("g.entries").alias("pos", "e"))
    return g.select("group", "pos", "e.id", "e.aliases", F.col("e.relatedIds").alias("related"), "e.description")


def json_schema(fields: dict[str, dict]) -> dict:
    """A closed Draft-07 schema of an entry's declared fields (name -> type, required, pattern, enum, min, max)."""
    names = {"pattern": "pattern", "enum": "enum", "min": "minLength", "max": "maxLength"}
    props = {k: {"type": f.get("type", "string")} | {names[r]: f[r] for r in names if r in f} for k, f in sorted(fields.items())}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "additionalProperties": False, "properties": props, "required": sorted(k for k, f in fields.items() if f.get("required"))}
