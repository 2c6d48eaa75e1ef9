"""Risk policies: seeding, choosing, switching, cloning, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_rules(rules: DataFrame) -> DataFrame:
    """A default policy's rules: the built-in ones without file names and recommendation type, all enabled."""
    return rules.select("signal", "name", "category", "description", "weight", F.lit(True).alias("enabled"), "threshold", "recommendation", "path_markers", "extensions", F.lit(False).alias("custom"), "rule_no")


def seed(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """policies (id, …) each with the rules of a default policy. The built-in rules are a fixed list, which stands in the plan as a literal."""
    listed = [r.asDict() for r in seed_rules(rules).orderBy("rule_no").collect()]
    kinds = {f.name: f.dataType for f in seed_rules(rules).schema}
    literal = lambda v, kind: F.array(*[F.lit(x) for x in v]).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)
    items = F.array(*[F.struct(*[literal(v, kinds[c]).alias(c) for c, v in r.items()]) for r in listed])
    return policies.withColumn("rule", F.explode(items)).select(*policies.columns, "rule.*")


def listed(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """The policies (id, version, is_active, created_at) with how many rules (id, enabled) they have and how many of them are on, the active one
    first, then the newest.
    """
    counts = rules.groupBy("id").agg(F.count("*").alias("n_rules"), F.count_if("enabled").alias("n_enabled"))
    d = policies.join(counts, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_rules", "n_enabled")})
    return d.orderBy(F.desc("is_active"), F.desc("created_at"), "id")


def get(policies: DataFrame, rules: DataFrame, policy_id: str) -> DataFrame:
    """One policy with its rules in order, one row; none if there is no such policy."""
    columns = [c for c in rules.columns if c != "id"]
    own = rules.where(F.col("id") == policy_id).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rule_no", *[c for c in columns if c != "rule_no"]))).alias("rules"))
    return policies.where(F.col("id") == policy_id).join(own, "id", "left")


def update(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules (id, signal, …) with the values of changes (id, signal and some of the other columns) where these are not null."""
    new = [c for c in changes.columns if c not in ("id", "signal")]
    c = changes.select("id", "signal", *[F.col(x).alias(f"new_{x}") for x in new])
    return rules.join(c, ["id", "signal"], "left").select(*[F.coalesce(f"new_{x}", x).alias(x) if x in new else F.col(x) for x in rules.columns])


def imported(rules: DataFrame, policy_id: str, rows: DataFrame) -> DataFrame:
    """rules (id, signal, …) where those of one policy are rows (signal and others): absent columns null, enabled unless they say otherwise."""
    have = {c: F.col(c) if c in rows.columns else F.lit(None) for c in rules.columns if c != "id"}
    kinds = {f.name: f.dataType for f in rules.schema}
    new = rows.select(F.lit(policy_id).cast(kinds["id"]).alias("id"), *[(F.coalesce(v, F.lit(True)) if c == "enabled" else v).cast(kinds[c]).alias(c) for c, v in have.items()])
    return rules.where(F.col("id") != policy_id).unionByName(new.dropDuplicates(["signal"]))


def active(policies: DataFrame) -> DataFrame:
    """The active policy, else the newest."""
    return policies.orderBy(F.desc("is_active"), F.desc("created_at"), "id").limit(1)


def set_active(policies: DataFrame, policy_id: str) -> DataFrame:
    return policies.withColumn("is_active", F.col("id") == policy_id)


def save(policies: DataFrame, changed: DataFrame) -> DataFrame:
    """policies with the rows of changed in place of those with the same id, or added."""
    return policies.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def clone(policies: DataFrame, policy_id: str, new_id: str, version: str) -> DataFrame:
    return policies.where(F.col("id") == policy_id).withColumns({"id": F.lit(new_id), "version": F.lit(version), "is_active": F.lit(False)})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """signal, change, old_weight, new_weight for rules (signal, weight, enabled) of two policies; unchanged ones left out.
    A rule whose weight and status both change gives two rows.
    """
    x, y = a.select("signal", F.col("weight").alias("old_weight"), F.col("enabled").alias("old_enabled")), b.select("signal", F.col("weight").alias("new_weight"), F.col("enabled").alias("new_enabled"))
    d = x.join(y, "signal", "full_outer")
    both = F.col("old_weight").isNotNull() & F.col("new_weight").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("old_weight").isNull(), "added"), F.when(F.col("new_weight").isNull(), "removed"),
        F.when(both & (F.abs(F.col("old_weight") - F.col("new_weight")) > 0.001), "weight_changed"), F.when(both & (F.col("old_enabled") != F.col("new_enabled")), "status_changed"),
    ))
    return d.select("signal", F.explode(kinds).alias("change"), "old_weight", "new_weight")


def rule_signal(name: Column) -> Column:
    """A custom rule's signal from its name."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def filter_rules(rules: DataFrame, category: str | None, query: str) -> DataFrame:
    """Rules of a category (None: all) whose name, signal or description contains the query, in any case."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("signal").contains(q) | F.lower("description").contains(q)
    return rules.where(hit if category is None else hit & (F.col("category") == category))
