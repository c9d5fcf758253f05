"""Guards, contracts and checks that decide whether something may be done, and what is told about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that tell a claim goes beyond its sources.
EXTRAPOLATION = ("extrapolate", "assume", "conclude that the team", "cultural dysfunction")
#: The one profile of normal forms that a registry may name.
NORMAL_PROFILE = {"encoding": "utf-8", "unicodeForm": "nfc", "whitespacePolicy": "collapse", "casePolicy": "lowercase_latin", "scriptPolicy": "preserve_non_latin"}


def provenance_guard(text: Column, sources: Column) -> Column:
    """struct(decision, confidence) of a claim: blocked without sources or with a phrase of extrapolation."""
    bare = F.coalesce(F.size(sources), F.lit(0)) <= 0
    beyond = F.lower(text).rlike("|".join(EXTRAPOLATION))
    decision = F.when(bare | F.coalesce(beyond, F.lit(False)), "block").otherwise("allow")
    return F.struct(decision.alias("decision"), F.when(~bare & F.coalesce(beyond, F.lit(False)), 0.98).otherwise(0.95).alias("confidence"))


def ledger_guard(observations: DataFrame, ledger: DataFrame) -> DataFrame:
    """observations (target, content, ...) with correction_id of the active correction that rejects the content, or null.

    ledger: (correction_id, subject, rejected_assertion, supersedes, seq). A correction is active
    if none supersedes it; of several the first counts. What has one is blocked before admission.
    """
    gone = ledger.filter("supersedes is not null").select(F.col("supersedes").alias("correction_id")).distinct()
    active = ledger.join(gone, "correction_id", "left_anti")
    first = active.groupBy(F.col("subject").alias("target"), F.col("rejected_assertion").alias("content")).agg(F.min_by("correction_id", "seq").alias("correction_id"))
    return observations.join(first, ["target", "content"], "left")


def seen_content(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows (digest, ...) with the first target (by seq) that a session has seen with the digest, or null."""
    first = seen.groupBy("digest").agg(F.min_by("target", "seq").alias("seen_as"))
    return rows.join(first, "digest", "left")


def id_map(pairs: DataFrame) -> DataFrame:
    """remote, local: the latest pair (by seq) of every remote id, with local ids that another pair took over left out."""
    latest = pairs.groupBy("remote").agg(F.max_by("local", "seq").alias("local"), F.max("seq").alias("seq"))
    owner = pairs.groupBy("local").agg(F.max("seq").alias("last"))
    return latest.join(owner, "local").filter("seq = last").select("remote", "local")


def judgment(state: DataFrame) -> DataFrame:
    """effect and confidence of states (duplicates, naming_issues: arrays): duplicates come first, then names, else nothing."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    effect = F.when(some("duplicates"), "duplicate_removal").when(some("naming_issues"), "rename").otherwise("no_op")
    return state.select("*", effect.alias("effect"), F.when(effect == "no_op", 1.0).otherwise(0.9).alias("confidence"))


def contract_errors(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected (contract, effect, path) that its contract's observed (contract, path) lack, with error."""
    error = F.when(F.col("effect") == "duplicate_removal", "invalid_path").when(F.col("effect") == "rename", "invalid_rename").otherwise("invalid_move")
    missing = expected.filter("effect != 'no_op'").join(observed.select("contract", "path").distinct(), ["contract", "path"], "left_anti")
    return missing.select("contract", "path", error.alias("error"))


def entry_errors(entries: DataFrame, groups: dict[str, dict]) -> DataFrame:
    """id, group, code, field of what is wrong with entries (group, id, fields map<string,string>).

    groups: name -> {required: [...], fields: [...], custom: bool, most: int}. Fields outside the
    group's own are custom: none if they are off, at most ``most`` otherwise.
    """
    rows = None
    error = lambda when, code, field: F.when(when, F.struct(F.lit(code).alias("code"), field.alias("field")))
    nothing = F.lit(None).cast("string")
    for name, g in groups.items():
        keys = F.map_keys("fields")
        missing = F.transform(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in g["required"]]).cast("array<string>"), keys)), lambda x: F.struct(F.lit("MISSING_REQUIRED_FIELD").alias("code"), x.alias("field")))
        custom = F.array_sort(F.array_except(keys, F.array(*[F.lit(x) for x in g["fields"]]).cast("array<string>")))
        if g.get("custom"):
            more = error(F.size(custom) > g.get("most", 1), "TOO_MANY_CUSTOM_FIELDS", nothing)
        else:
            more = error(F.size(custom) > 0, "CUSTOM_FIELDS_DISABLED", nothing)
        found = entries.filter(F.col("group") == name).select("id", "group", F.explode(F.concat(missing, F.array_compact(F.array(more)))).alias("e"))
        rows = found if rows is None else rows.unionByName(found)
    known = [F.lit(x) for x in groups]
    lost = entries.filter(~F.col("group").isin(*known) | F.col("group").isNull()).select("id", "group", F.struct(F.lit("GROUP_NOT_FOUND").alias("code"), nothing.alias("field")).alias("e"))
    rows = lost if rows is None else rows.unionByName(lost)
    return rows.select("id", "group", "e.code", "e.field")


def search_policy_errors(policy: dict) -> list[str]:
    """INVALID_SEARCH_POLICY unless the similarity lies in 0..1 and the other limits are above 0."""
    s = policy.get("fuzzyMinSimilarity")
    ok = isinstance(s, (int, float)) and 0 <= s <= 1 and all(isinstance(policy.get(k), int) and policy[k] > 0 for k in ("fuzzyCandidateLimit", "fuzzyNgramSize", "maxFuzzyNgramPostings"))
    return [] if ok else ["INVALID_SEARCH_POLICY"]


def normal_profile(profile: dict) -> bool:
    return all(profile.get(k) == v for k, v in NORMAL_PROFILE.items())


# --- regrets ---

#: What a regret of a kind takes from a content's aggressiveness.
REGRETS = {"dedup_re_read": 0.075, "verifier_fallback": 0.15, "information_loss": 0.3}


def regret_deltas(events: DataFrame) -> DataFrame:
    """key, seq, delta of events (key, seq, kind), for the fold of aggressiveness; a success gives back 0.02."""
    cost = F.create_map(*[x for k, v in REGRETS.items() for x in (F.lit(k), F.lit(-v))])
    return events.select("key", "seq", F.coalesce(F.try_element_at(cost, F.col("kind")), F.lit(0.02)).alias("delta"))


def most_regretted(events: DataFrame, levels: DataFrame, k: int = 5) -> DataFrame:
    """key, regrets, level of the k keys with most regrets; ties by key."""
    counts = events.filter(F.col("kind").isin(*REGRETS)).groupBy("key").agg(F.count(F.lit(1)).alias("regrets"))
    return counts.join(levels, "key").orderBy(F.desc("regrets"), "key").limit(k)


def regret_report(events: DataFrame, levels: DataFrame) -> DataFrame:
    """text: the report of all events, the five most regretted below."""
    total = events.filter(F.col("kind").isin(*REGRETS)).agg(F.count(F.lit(1)).alias("n"))
    top = most_regretted(events, levels)
    line = F.format_string("  %s — %d regrets, aggressiveness: %.2f", "key", "regrets", "level")
    lines = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("regrets")).alias("r"), "key", line.alias("l")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x.l), "\n")
    head = F.format_string("regrets: %d events", "n")
    return total.crossJoin(lines).select(F.when(F.size("x") == 0, F.concat(head, F.lit("\n  No regret events recorded."))).otherwise(F.concat(head, F.lit("\n  Most regretted:\n"), body)).alias("text"))


def recommended(keys: DataFrame, levels: DataFrame) -> DataFrame:
    """key, level: 0.5 for keys never seen."""
    return keys.join(levels, "key", "left").select("key", F.coalesce("level", F.lit(0.5)).alias("level"))


def change_summary(changes: DataFrame) -> DataFrame:
    """text: how many changes (op) of each kind a set has."""
    n = lambda op: F.count_if(F.col("op") == op)
    return changes.agg(F.format_string("Sync Plan: %d inserts, %d updates, %d deletes, %d moves", n("insert"), n("update"), n("delete"), n("move")).alias("text"))
