"""Operations on stored tables: latest per key, history, upserts, cascades, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import first_per_key


def latest(df: DataFrame, keys: list[str], at: str = "created_at", tie: str = "id") -> DataFrame:
    return first_per_key(df, keys, [F.desc(at), F.col(tie)])


def history(analyses: DataFrame, limit: int = 50) -> DataFrame:
    """The newest `limit` analyses of each repository, with their rank."""
    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), "id")
    return analyses.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search_history(analyses: DataFrame, query: str, limit: int) -> DataFrame:
    """Analyses in order whose id, trigger, level, any module or any file contains the query, in any case."""
    q = query.lower()
    has = lambda c: F.lower(F.col(c)).contains(q)
    hit = has("id") | has("trigger") | has("risk_level") | F.exists("modules", lambda m: F.lower(m).contains(q)) | F.exists("files", lambda f: F.lower(f).contains(q))
    return analyses.where(hit).orderBy("ord").limit(limit)


def repositories(repos: DataFrame, user: str | None = None) -> DataFrame:
    """Repositories by name: of a user, or those of no user."""
    return repos.where(F.col("user_id").isNull() if user is None else F.col("user_id") == user).orderBy("name", "id")


def by_priority(providers: DataFrame) -> DataFrame:
    """Enabled providers as candidates: the default first, then by priority."""
    return providers.where("enabled").orderBy(F.desc("is_default"), "priority", "id")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def overwrite_latest(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots in which each repository's latest row takes the content of new (one row a repository); others are added."""
    last = latest(snapshots, ["repository_id"]).select("repository_id", F.col("id").alias("last_id"))
    ids = new.drop("id").join(last, "repository_id", "left").join(new.select("repository_id", F.col("id").alias("new_id")), "repository_id")
    rows = ids.withColumn("id", F.coalesce("last_id", "new_id")).select(*snapshots.columns)
    return upsert(snapshots, rows, ["id"])


def replace_partition(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Everything of the keys in new goes; new comes in."""
    return upsert(stored, new, [key])


def cascade_delete(repos: DataFrame, children: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """repositories and each child table without the doomed repositories (id)."""
    ids = doomed.select("id").distinct()
    out = {"repositories": repos.join(ids, "id", "left_anti")}
    key = ids.withColumnRenamed("id", "repository_id")
    return out | {name: df.join(key, "repository_id", "left_anti") for name, df in children.items()}


def purge_ephemeral(df: DataFrame, older_than) -> DataFrame:
    """Rows but ephemeral ones from before a time."""
    return df.where(~(F.coalesce("is_ephemeral", F.lit(False)) & (F.col("created_at") < F.lit(older_than))))


def storage_use(analyses: DataFrame, quota: int = 31_457_280) -> DataFrame:
    """user_id, bytes, over_quota of stored payloads (user_id, payload)."""
    return analyses.where("user_id IS NOT NULL").groupBy("user_id").agg(F.sum(F.octet_length("payload")).alias("bytes")).withColumn("over_quota", F.col("bytes") > quota)


def merge_partial(full: DataFrame, partial: DataFrame, keys: list[str], collections: list[str]) -> DataFrame:
    """full with empty or null collections filled from partial."""
    p = partial.select(*keys, *[F.col(c).alias(f"p_{c}") for c in collections])
    fill = {c: F.when(F.coalesce(F.size(F.col(c)), F.lit(0)) > 0, F.col(c)).otherwise(F.col(f"p_{c}")) for c in collections}
    return full.join(p, keys, "left").withColumns(fill).drop(*[f"p_{c}" for c in collections])


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, content) whose content hash no usable cache row has; rows of language text or generic don't count."""
    usable = cache.where(~F.col("language").isin("text", "generic")).select("file_hash").distinct()
    return files.withColumn("file_hash", F.sha2(F.col("content"), 256)).join(usable, "file_hash", "left_anti")


def progress(status: Column) -> Column:
    """Percent done of a job status."""
    steps = {"PENDING": 5, "CLONING": 15, "PARSING": 40, "BUILDING_GRAPH": 65, "SCORING": 85, "COMPLETED": 100}
    out = None
    for k, v in steps.items():
        out = F.when(status == k, v) if out is None else out.when(status == k, v)
    return out
