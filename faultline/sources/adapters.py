"""Code-shaped views over the star-schema tables, so that every operator can run at any scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P

DIRS = ["src/auth", "src/lib", "app/api/users", "backend/models", "docs", "tests", "scripts", "frontend/components", "core/utils", "payment", "k8s", "build/gen"]
EXTS = [".py", ".ts", ".tsx", ".kt", ".java", ".sql", ".tf", ".md"]
#: Names that the generated paths don't have; each comes with a near miss.
SPECIAL = [
    ".env", ".env.local", "Dockerfile", "docker-compose.yml", ".github/workflows/ci.yml", "src/session_manager.py", "lib/password_utils.ts", "src/hash.ts",
    "app/AndroidManifest.xml", "package.json", "rbac/roles.py", "db/drop_table_x.sql", "api/router.delete.ts", "x/config.py", "settings/settings.py", "a.b.c", "x.",
    "src\\win\\auth\\login.py", "README", "LICENSE", "latest.py", "com/example/App.kt", "examples/demo.ts", "src/example/x.py", "app/page.tsx", "middleware.ts",
    "workers/job.py", "src/client.ts", "db/session.py", "tools/session.py", "alembic/env.py", "src/UserActivity.kt", "web/app.min.js", "img/logo.PNG", "notes.txt~",
    "helm/values.yaml", "infra/main.tf", "shared/x/y.go", "checkout/cart.ts", "tests/test_a.py", "src/test_b.py", "FooTest.java", "build.gradle.kts", "sub/build-logic.kts",
    ".idea/workspace.xml", "out/x.js", "__init__.py", "pkg/__init__.py", "bin/run", "go.mod", "crypto/aes_tool.rs", "secrets.yaml", "my-secret.ts", "models/user.py", "schema/v1.graphql",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], k) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))


def part_path() -> F.Column:
    return F.concat(pick(DIRS, F.col("p_partkey") % len(DIRS)), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), pick(EXTS, F.col("p_size") % len(EXTS)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, path of a generated file for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), part_path().alias("path"))


def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files and the special names, these with negative ord."""
    special = spark.createDataFrame([(-k, p) for k, p in enumerate(SPECIAL, 1)], "ord long, path string")
    return files(spark, sf_dir).unionByName(special)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct pairs of parts on consecutive lines of an order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return l.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()


def changed(spark: SparkSession, sf_dir: str, large: bool = False) -> DataFrame:
    """analysis_id, ord, path: the parts of an order (or of a customer's orders) as a change set."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    if large:
        o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("analysis_id"))
        l = l.join(o, "l_orderkey").select("analysis_id", "l_partkey")
    else:
        l = l.select(F.col("l_orderkey").alias("analysis_id"), "l_partkey")
    return l.distinct().withColumnRenamed("l_partkey", "ord").join(files(spark, sf_dir), "ord").select("analysis_id", "ord", "path")


def last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord of the parts of the newest order: the change set whose blast radius is asked for."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("ord"))
    return l.join(l.agg(F.max("l_orderkey").alias("l_orderkey")), "l_orderkey").select("ord").distinct()


def inputs(spark: SparkSession, sf_dir: str, large: bool = False) -> DataFrame:
    """What scoring needs of each change set; lists of symbols and hubs are made from its parts."""
    return inputs_of(changed(spark, sf_dir, large))


def inputs_of(changes: DataFrame) -> DataFrame:
    """inputs() of change sets (analysis_id, ord, path)."""
    # what hangs on the path alone is found once a path
    facts = changes.select("path").distinct().withColumns({
        "module": P.impacted_module(F.col("path")), "critical": P.contains_any(F.lower("path"), V.CRITICAL_ANALYZER), "is_test": P.is_test_path(F.col("path")),
        "flag": P.contains_any(F.lower("path"), V.FLAG_WORDS), "deploys": P.contains_any(F.lower("path"), V.DEPLOY_WORDS),
    })
    c = changes.join(facts, "path")
    # one list a change set, in order of ord; the others are cut from it
    row = F.struct("ord", "path", "module", F.when(F.col("critical"), F.col("path")).alias("critical"))
    d = c.groupBy("analysis_id").agg(
        F.sort_array(F.collect_list(row)).alias("x"), F.sum(F.expr("CAST(ord % 7 AS INT)")).cast("int").alias("dependency_count"), (~F.bool_or("is_test")).alias("missing_tests"),
        F.bool_or("flag").alias("flags"), F.bool_or("deploys").alias("deploy"),
        F.sum(F.expr("CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END")).cast("int").alias("edges"), F.sum(F.expr("CASE WHEN ord % 5 = 0 THEN 2 ELSE 0 END")).cast("int").alias("unique_components"),
    )
    distinct = lambda field: F.sort_array(F.array_distinct(F.array_compact(F.col(f"x.{field}"))))
    named = lambda prefix, n: F.sort_array(F.array_distinct(F.transform(F.filter("x.ord", lambda o: o % n == 0), lambda o: F.concat(F.lit(prefix), o.cast("string")))))
    return d.select(
        "analysis_id", F.col("x.path").alias("files"), distinct("module").alias("impacted_modules"), "dependency_count", "missing_tests", distinct("critical").alias("critical_modules"),
        named("fn_", 3).alias("affected_functions"), named("hub_", 11).alias("hub_nodes"), named("bridge_", 13).alias("bridge_nodes"), "flags", "deploy", "edges", "unique_components",
    ).withColumn("ownership", F.expr("map(files[0], concat('owner_', analysis_id))"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): two versions of a tree with a file (path, text) for each document. By doc_id % 10, 1 is moved, 2 deleted, 3 added, 4
    moved and edited, 5 to 7 edited; an edit drops every fifth line, changes others and adds one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 10
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 1, F.lit(None)).when(i % 5 == 3, F.concat(x, F.lit(" edited"))).otherwise(x)), lambda x: x.isNotNull())
    edited = F.concat(F.array_join(lines, "\n"), F.lit("\nend of "), F.col("doc_id").cast("string"))
    at = lambda folder: F.concat(F.lit(folder), "doc_id", F.lit(".txt")).alias("path")
    old = docs.where(k != 3).select(at("d/"), "text")
    new = docs.where(k != 2).select(F.when(k.isin(1, 4), at("moved/")).otherwise(at("d/")).alias("path"), F.when((k >= 4) & (k <= 7), edited).otherwise(F.col("text")).alias("text"))
    return old, new


def code_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): repo_id, analysis_id, ord, path, text of five repositories with a file for each part, every third of which changes: Python
    files in the second of their two functions, others in a comment.
    """
    k = F.col("ord")

    def side(version: str) -> DataFrame:
        v = F.when(k % 3 == 0, F.lit(version)).otherwise("0")
        code = F.format_string("def f%d_a(x):\n    return x\n\n\ndef f%d_b(x):\n    return x + %s\n", k, k, v)
        text = F.when(F.col("path").endswith(".py"), code).otherwise(F.format_string("// file number %d in its version %s\n", k, v))
        return files(spark, sf_dir).select(F.concat(F.lit("r"), k % 5).alias("repo_id"), (k % 5).alias("analysis_id"), "ord", "path", text.alias("text"))

    return side("1"), side("2")
