"""Duplicate groups: by name, by content in stages, by similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names

EDGE = 64 * 1024


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key others share, with their number n. No group is gathered: counts are summed
    before they move, and a hot key's rows only stream past its count."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(counts, key)


def name_members(files: DataFrame, whole: bool = False) -> DataFrame:
    """by_name in long form: key, path, n. For groups of any size."""
    key = F.lower("name") if whole else F.lower(names.stem(F.col("name")))
    return _shared(files.select(key.alias("key"), "path"), ["key"])


def content_members(files: DataFrame, edge: int = EDGE) -> DataFrame:
    """by_content in long form: size, sha256, path, n. For groups of any size."""
    rows = files.select("path", "size", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).filter("sha256 is not null")
    return _shared(rows, ["size", "sha256"])


def by_name(files: DataFrame, whole: bool = False) -> DataFrame:
    """Groups of files of one stem (or whole name), case aside: key, items, n, similarity.

    A row holds its whole group; name_members() has the same groups without that bound.
    """
    key = F.lower("name") if whole else F.lower(names.stem(F.col("name")))
    groups = files.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list("path")).alias("items"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").withColumn("similarity", F.lit(1.0))


def hard_links(files: DataFrame) -> DataFrame:
    """device, inode, path, n: files (path, device, inode, links) that share an inode with others of the inventory."""
    return _shared(files.filter("links > 1").select("device", "inode", "path"), ["device", "inode"])


def content_kinds(members: DataFrame, files: DataFrame) -> DataFrame:
    """kind of each content group (size, sha256 of content_members()): hard_links if all its files are one inode, else same_content."""
    rows = members.join(files.select("path", "device", "inode"), "path", "left")
    one = (F.count_if(F.col("inode").isNull()) == 0) & (F.min(F.struct("device", "inode")) == F.max(F.struct("device", "inode")))
    return rows.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("n"), F.when(one, "hard_links").otherwise("same_content").alias("kind"))


def partial_hash(content: Column, edge: int = EDGE) -> Column:
    """SHA-256 of the first and, of longer contents, the last edge bytes."""
    data = content.cast("binary")
    tail = F.when(F.octet_length(data) > edge, F.substring(data, -edge, edge)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.substring(data, 1, edge), tail), 256)


def by_content(files: DataFrame, edge: int = EDGE) -> DataFrame:
    """Groups of equal contents: size, partial_sha256, sha256, items, n.

    Files go by size first, those that share one by partial hash, and the rest by full hash;
    each stage hands on what has a partner. The stages exchange sizes and hashes, never contents:
    each file carries its two hashes, which are worked out in the scan. A row holds its whole
    group; content_members() has the same groups without that bound.
    """
    hashed = files.select("path", "size", partial_hash(F.col("content"), edge).alias("partial_sha256"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).filter("sha256 is not null")
    groups = hashed.groupBy("size", "partial_sha256", "sha256").agg(F.array_sort(F.collect_list("path")).alias("items"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1")


def stage_counts(files: DataFrame, edge: int = EDGE) -> DataFrame:
    """files, size_candidates, partial_candidates, full_candidates, unreadable: one row."""
    hashed = files.select("size", partial_hash(F.col("content"), edge).alias("p"), F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    full = hashed.groupBy("size", "p", "h").agg(F.count(F.lit(1)).alias("n"))
    part = full.groupBy("size", "p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("full"), F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(0)).alias("bad"))
    size = part.groupBy("size").agg(F.sum("n").alias("n"), F.sum("full").alias("full"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("p").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("part"))
    many = F.col("n") > 1
    zero = F.lit(0).cast("bigint")
    return size.agg(
        F.coalesce(F.sum("n"), zero).alias("files"),
        F.coalesce(F.sum(F.when(many, F.col("n")).otherwise(zero)), zero).alias("size_candidates"),
        F.coalesce(F.sum(F.when(many, F.col("part")).otherwise(zero)), zero).alias("partial_candidates"),
        F.coalesce(F.sum(F.when(many, F.col("full")).otherwise(zero)), zero).alias("full_candidates"),
        F.coalesce(F.sum("bad"), zero).alias("unreadable"),
    )


def char_grams(text: Column, n: int) -> Column:
    """Distinct windows of n characters; a shorter text is one window, an empty one none."""
    size = F.char_length(text)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(text)).otherwise(F.array_distinct(many))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / the longer length, in characters; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def near_names(files: DataFrame, threshold: float = 0.9, n: int = 3, cap: int = 256, bucket: int = 4096) -> DataFrame:
    """Pairs (bucket, left_name, right_name, similarity) of names in one size bucket whose lower-cased names nearly agree.

    Files of equal name are one entry here, so a common name costs one row a gram; grams of
    more than cap entries of a bucket propose nothing. Equal names are no near pair.
    """
    rows = files.select("path", F.lower("name").alias("name"), F.floor(F.col("size") / bucket).alias("bucket"))
    entries = rows.select("bucket", "name").distinct()
    grams = entries.select("bucket", "name", F.explode(char_grams(F.col("name"), n)).alias("gram"))
    few = grams.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("m")).filter((F.col("m") > 1) & (F.col("m") <= cap)).select("bucket", "gram")
    grams = grams.join(few, ["bucket", "gram"])
    a, b = grams.alias("a"), grams.alias("b")
    near = F.char_length("a.name") - F.char_length("b.name")
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.name") < F.col("b.name")) & (F.abs(near) <= (1 - threshold) * F.greatest(F.char_length("a.name"), F.char_length("b.name"))))
    pairs = met.select(F.col("a.bucket").alias("bucket"), F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name")).distinct()
    return pairs.withColumn("similarity", similarity(F.col("left_name"), F.col("right_name"))).filter(F.col("similarity") >= threshold)


def name_counters(files: DataFrame, threshold: float = 0.9, n: int = 3, cap: int = 256, bucket: int = 4096) -> DataFrame:
    """possible, candidates, matches, skipped: what the near-name search of files met, in one row.

    possible: pairs of distinct names of one bucket; candidates: those that share a gram of at
    most cap entries; skipped: entries of grams beyond the cap.
    """
    entries = files.select(F.lower("name").alias("name"), F.floor(F.col("size") / bucket).alias("bucket")).distinct()
    grams = entries.select("bucket", "name", F.explode(char_grams(F.col("name"), n)).alias("gram"))
    sizes = grams.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("m"))
    whole = F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("bigint")
    possible = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).agg(whole.alias("possible"))
    skipped = sizes.agg(F.coalesce(F.sum(F.when(F.col("m") > cap, F.col("m"))), F.lit(0)).cast("bigint").alias("skipped"))
    few = grams.join(sizes.filter((F.col("m") > 1) & (F.col("m") <= cap)).select("bucket", "gram"), ["bucket", "gram"])
    a, b = few.toDF("bucket", "gram", "one"), few.toDF("bucket", "gram", "two")
    met = a.join(b, ["bucket", "gram"]).filter("one < two").select("bucket", "one", "two").distinct()
    met = met.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(similarity(F.col("one"), F.col("two")) >= threshold).alias("matches"))
    return possible.crossJoin(met).crossJoin(skipped)


def ordered(groups: DataFrame) -> DataFrame:
    """Groups (kind, items, similarity) as a report lists them: similar ones first, then by kind and items."""
    return groups.orderBy(F.desc("similarity"), "kind", "items") if "similarity" in groups.columns else groups.orderBy("kind", "items")


def without_allowed(groups: DataFrame, sha256: list[str] = (), globs: list[str] = (), pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """groups less those that a rule allows: by hash, by a text in every path, or by two paths."""
    allowed = F.lit(False)
    for h in sha256:
        allowed = allowed | (F.lower("sha256") == h.lower())
    for text in map(F.lit, globs):
        allowed = allowed | _all_contain(text)
    for a, b in pairs:
        allowed = allowed | (F.array_contains("items", a) & F.array_contains("items", b))
    return groups.filter(~allowed)


def _all_contain(text: Column) -> Column:
    return F.forall("items", lambda p: F.contains(p, text))


def plan(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Actions of groups: every item but the first, with its size: canonical, path, size."""
    rest = groups.select(F.element_at("items", 1).alias("canonical"), F.explode(F.slice("items", F.lit(2), F.size("items"))).alias("path"))
    return rest.join(files.select("path", "size"), "path", "left")


def simulate(actions: DataFrame, files: DataFrame, root: str, allowed: list[str] = (), protected: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """actions with rejection, the first of the rules that an action breaks, or null."""
    now = files.select("path", F.col("size").alias("size_now"))
    joined = actions.join(now, "path", "left")
    shield = F.exists(F.split("path", "/"), lambda s: s.isin(*protected))
    why = (
        F.when(F.col("path").isin(*allowed) if allowed else F.lit(False), "allowed")
        .when(~names.within(F.col("path"), [root]), "outside root")
        .when(shield, "protected")
        .when(F.col("size_now").isNull(), "missing")
        .when(F.col("size_now") != F.col("size"), "size changed")
    )
    return joined.withColumn("rejection", why).drop("size_now")


def treemap(files: DataFrame) -> DataFrame:
    """Per first path segment: name, total, n, largest first."""
    return files.groupBy(names.first_segment(F.col("path")).alias("name")).agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), "name")
