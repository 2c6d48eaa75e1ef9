"""Dependency graphs from parsed files: nodes, edges, import resolution, fan metrics, quality counters.

files: repo_id, ord, file_path, language, package_name, imports, defined_classes, class_symbols, function_symbols,
api_routes, package_deps, framework_signals (as parsers.parse gives them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby, takewhile
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..plans.durable import keep

# What may follow an import's base path, in order of preference
CANDIDATE_ENDINGS = ["", ".kt", ".kts", ".java", ".ts", ".tsx", ".js", ".jsx", ".py", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
ALIAS_ROOTS = ["src/", "frontend/", "app/", ""]
DOTTED_ENDINGS = [".py", ".ts", ".tsx", ".js", ".jsx", ".kt", ".java"]


def change_set_graph(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of change sets (analysis_id, ord, path): the top module owns each file."""
    d = changed.withColumn("top", F.when(F.col("path").contains("/"), F.get(F.split("path", "/"), F.lit(0))).otherwise("root"))
    modules = d.groupBy("analysis_id", "top").agg(F.min("ord").alias("ord")).select("analysis_id", F.concat(F.lit("module:"), "top").alias("id"), F.col("top").alias("label"), F.lit("module").alias("kind"), "ord")
    own = d.select("analysis_id", F.concat(F.lit("file:"), "path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("file").alias("kind"), "ord")
    edges = d.select("analysis_id", F.concat(F.lit("module:"), "top").alias("source"), F.concat(F.lit("file:"), "path").alias("target"), F.lit("owns").alias("relationship"), F.lit("SOURCE_IMPORT").alias("edge_type"), "ord")
    return modules.unionByName(own), edges


def relative_base(current: Column, src: Column) -> Column:
    """Normalised base path of a '.'-relative import seen from a file."""
    seg = F.split(P.slashed(current), "/")
    folder = F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "/")
    dots = F.length(F.regexp_extract(src, r"^(\.*)", 1))
    bare = F.regexp_replace(src, r"^\.+", "")
    up = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), bare)
    rel = F.when(src.startswith("./"), F.substring(src, F.lit(3), F.length(src))).otherwise(up)
    return P.normalize_path(F.when(folder != "", F.concat(folder, F.lit("/"), rel)).otherwise(rel))


def import_bases(current: Column, src: Column) -> Column:
    """Base paths an import may mean, best first: relative ones only for '.', aliases for '@/', then path and dotted path."""
    clean = F.trim(P.slashed(src))
    alias = F.array(*[F.concat(F.lit(r), F.substring(clean, F.lit(3), F.length(clean))) for r in ALIAS_ROOTS])
    plain = F.array(P.normalize_path(clean), F.when(clean.contains("."), F.replace(clean, F.lit("."), F.lit("/"))))
    aliased = F.when(clean.startswith("@/"), alias).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.when(clean.startswith("."), F.array(relative_base(current, clean))).otherwise(F.concat(aliased, plain)))


def candidates(bases: Column) -> Column:
    """Every base with every ending, in order of preference."""
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in CANDIDATE_ENDINGS])))


#: Letters of the grams that index paths for substring search; longer needles have grams of twice as many, and again up to DOUBLINGS times.
GRAM, DOUBLINGS = 6, 8


def _gram_size(length: Column) -> Column:
    """The letters of the grams of a needle: all it has up to GRAM, then GRAM times the largest power of two that fits, over half of it."""
    size = F.least(length, F.lit(GRAM))
    for k in range(1, DOUBLINGS + 1):
        size = F.when(length >= GRAM << k, GRAM << k).otherwise(size)
    return size


def possible(needles: DataFrame, files: DataFrame) -> DataFrame:
    """The needles (repo_id, needle) whose grams of GRAM letters, one behind the other and the last, some path of the repository has each, and those
    of fewer letters. Only distinct grams are shuffled, as hashes and without their paths; a hash shared by chance lets a needle through.
    """
    start = lambda c, step: F.sequence(F.lit(1), F.length(c) - GRAM + 1, F.lit(step))
    hashed = lambda c, at: F.transform(at, lambda i: F.xxhash64(F.substring(c, i, GRAM)))
    has = files.where(F.length("path") >= GRAM).select("repo_id", F.explode(hashed("path", start("path", 1))).alias("gram")).distinct()
    long = needles.where(F.length("needle") >= GRAM)
    asked = long.select("repo_id", "needle", F.explode(F.array_distinct(hashed("needle", F.concat(start("needle", GRAM), F.array(F.length("needle") - GRAM + 1))))).alias("gram"))
    known = asked.select("repo_id", "gram").distinct().join(has, ["repo_id", "gram"], "left_anti")
    absent = asked.join(known, ["repo_id", "gram"], "left_semi").select("repo_id", "needle").distinct()
    return needles.join(absent, ["repo_id", "needle"], "left_anti")


def looked_up(needles: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short, long) for needles (repo_id, needle) and files (repo_id, path): short has the smallest path with each needle of up to GRAM
    letters, long the paths that have the rarer of a longer needle's first and last gram, which cover it. Such a path hardly ever
    lacks the needle, however many paths there are; where grams of fixed length fill up, their paths grow with the tree.
    """
    needles = keep(possible(needles.where("needle <> ''").distinct(), files).withColumn("size", _gram_size(F.length("needle"))))
    # long grams stand for themselves by hash: what they find is compared anyway
    gram = lambda c, i, n: F.when(n <= GRAM, F.substring(c, i, n)).otherwise(F.lpad(F.hex(F.xxhash64(F.substring(c, i, n))), 16, "0"))
    size = F.col("size")
    ends = F.array_distinct(F.array(gram(F.col("needle"), F.lit(1), size), gram(F.col("needle"), F.length("needle") - size + 1, size)))
    asked = keep(needles.select("repo_id", "needle", F.explode(ends).alias("gram")))
    # only grams as long as those asked for; a short row a repository, so no path is dealt by its repository alone
    sizes = F.broadcast(needles.groupBy("repo_id").agg(F.collect_set("size").alias("sizes")))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length("path") - n + 1), lambda i: gram(F.col("path"), i, n))
    per = F.array_distinct(F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("path")), every)))
    index = files.select("repo_id", "path").join(sizes, "repo_id").select("repo_id", "path", F.explode(per).alias("gram"))
    index = keep(index.join(asked.select("repo_id", "gram").distinct(), ["repo_id", "gram"], "left_semi"))
    frequency = index.groupBy("repo_id", "gram").agg(F.count("*").alias("df"), F.min("path").alias("least"))
    found = asked.join(frequency, ["repo_id", "gram"], "left")
    rarest = found.groupBy("repo_id", "needle").agg(F.min(F.struct("df", "gram", "least")).alias("x"), F.bool_or(F.col("df").isNull()).alias("absent")).where("NOT absent")
    rarest = keep(rarest.select("repo_id", "needle", "x.gram", "x.least"))
    short = rarest.where(F.length("needle") <= GRAM).select("repo_id", "needle", F.col("least").alias("path"))
    return short, rarest.where(F.length("needle") > GRAM).select("repo_id", "needle", "gram").join(index, ["repo_id", "gram"]).select("repo_id", "needle", "path")


def containing(needles: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, needle, path: of each needle (repo_id, needle) that paths of its repository (repo_id, path) contain, the smallest such path.

    An inverted index of the paths' grams (looked_up): a needle of up to GRAM letters is one itself, a longer one is compared with
    the paths that have its first or last gram. A needle with a gram that no path has is dropped before that.
    """
    short, long = looked_up(needles, files)
    met = long.where(F.contains("path", "needle"))
    return short.unionByName(met.groupBy("repo_id", "needle").agg(F.min("path").alias("path")))


def rewritten(imports: DataFrame, aliases: DataFrame, key: tuple[str, ...] = ("repo_id", "ord", "k")) -> DataFrame:
    """imports (repo_id, src and the rest of the key) with the first alias (repo_id, ord, prefix, replacement) that src begins with replaced. Prefixes of
    the lengths that a repository's aliases have are joined equally; those lengths are a short row a repository.
    """
    key = list(key)
    sizes = aliases.groupBy("repo_id").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    heads = F.transform(F.filter("sizes", lambda n: n <= F.length("src")), lambda n: F.left("src", n))
    asked = imports.join(F.broadcast(sizes), "repo_id").select(*key, F.explode(heads).alias("prefix"))
    hit = asked.join(aliases.select("repo_id", "prefix", "replacement", F.col("ord").alias("a_ord")), ["repo_id", "prefix"])
    first = hit.groupBy(*key).agg(F.min(F.struct("a_ord", "prefix", "replacement")).alias("x"))
    d = imports.join(first, key, "left")
    src = F.when(F.col("x").isNotNull(), F.concat("x.replacement", F.substring("src", F.length("x.prefix") + 1, F.length("src")))).otherwise(F.col("src"))
    return d.withColumn("src", src).drop("x")


def _by_base(files: DataFrame) -> DataFrame:
    """repo_id, base, rank, path: each file (repo_id, path) under what is left of it without each of CANDIDATE_ENDINGS that it has."""
    cut = lambda k, e: F.struct(F.lit(k).alias("rank"), F.left("path", F.length("path") - len(e)).alias("base"))
    cuts = F.array_compact(F.array(*[F.when(F.col("path").endswith(e), cut(k, e)) for k, e in enumerate(CANDIDATE_ENDINGS)]))
    return files.select("repo_id", "path", F.explode(cuts).alias("x")).select("repo_id", "x.base", "x.rank", "path").distinct()


def _by_tail(files: DataFrame) -> DataFrame:
    """repo_id, tail, rank, path: the best file (repo_id, path) for each end of a path, from a folder on, without one of DOTTED_ENDINGS."""
    k = F.lit(None).cast("int")
    for n, e in reversed(list(enumerate(DOTTED_ENDINGS))):
        k = F.when(F.col("path").endswith(e), n).otherwise(k)
    size = F.element_at(F.array(*[F.lit(len(e)) for e in DOTTED_ENDINGS]), F.col("rank") + 1)
    seg = F.split(F.left("path", F.length("path") - size), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, n, F.size(seg)), "/"))
    d = files.withColumn("rank", k).where("rank IS NOT NULL").select("repo_id", "rank", "path", F.explode(tails).alias("tail"))
    return d.groupBy("repo_id", "tail").agg(F.min(F.struct("rank", "path")).alias("x")).select("repo_id", "tail", "x.rank", "x.path")


def _folder_asked(src: Column, path: Column, aliases: DataFrame | None, imports: DataFrame) -> tuple[DataFrame, Column]:
    """(imports, folder): the folder of an importing file where its import may be relative, else an empty text. An alias makes it so
    if its replacement begins with a dot or is blank before one; imports get a short row of their repository's such aliases.
    """
    seg = F.split(P.slashed(path), "/")
    relative = src.startswith(".")
    if aliases is not None:
        real = F.trim(P.slashed(F.col("replacement")))
        dots = aliases.groupBy("repo_id").agg(F.collect_set(F.when(real == "", F.length("prefix"))).alias("blank"), F.bool_or(real.startswith(".")).alias("dotted"))
        imports = imports.join(F.broadcast(dots), "repo_id", "left")
        bared = F.exists("blank", lambda n: F.trim(F.substring(src, n + 1, F.length(src))).startswith("."))
        relative = relative | F.coalesce(F.col("dotted"), F.lit(False)) | F.coalesce(bared, F.lit(False))
    return imports, F.when(relative, F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "/")).otherwise("")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports (repo_id, ord, file_path, k, source_module, …) with target_path, null where nothing fits.

    What is imported, and from which folder if it may be relative, decides the target, so each such question is answered once, however many
    files ask it, and imports are only joined with the answers. A ladder of equal joins: package and class names, then, with the first of a
    repository's aliases (repo_id, ord, prefix, replacement) put in, candidate paths and dotted suffixes; files stand under what they are
    without their endings, so no import is tried with every ending. What these leave is looked for anywhere in paths, and then by stems of at least
    three letters. A relative import ends with its candidate paths. Where several files fit a rung the smallest path counts.
    """
    given, key = imports.columns, ["repo_id", "q"]
    asking, folder = _folder_asked(F.trim(P.slashed(F.col("source_module"))), F.col("file_path"), aliases, imports)
    asking = asking.withColumns({"asked_src": F.trim(P.slashed(F.col("source_module"))), "asked_from": folder}).select(*given, "asked_src", "asked_from")
    same = ["repo_id", "asked_src", "asked_from"]
    asked = keep(asking.select(*same).where("asked_src IS NOT NULL").distinct().withColumn("q", F.monotonically_increasing_id()))
    f = files.select("repo_id", "ord", "file_path", "package_name", "defined_classes")
    paths = f.select("repo_id", F.col("file_path").alias("path"))
    packaged = f.where("coalesce(package_name, '') <> ''")
    names = packaged.select("repo_id", "ord", "file_path", F.explode(F.concat(F.array("package_name"), F.transform("defined_classes", lambda c: F.concat("package_name", F.lit("."), c)), "defined_classes")).alias("name"))
    names = names.groupBy("repo_id", "name").agg(F.max_by("file_path", "ord").alias("path"))
    named = asked.select(*key, F.posexplode(F.array(F.col("asked_src"), F.element_at(F.split("asked_src", r"\."), -1))).alias("rank", "name"))
    by_name = named.join(names, ["repo_id", "name"]).select(*key, F.lit(1).alias("rung"), "rank", "path")
    i = asked.select(*key, F.col("asked_src").alias("src"), "asked_from")
    i = keep((i if aliases is None else rewritten(i, aliases, tuple(key))).select(*key, "asked_from", "src").where("src <> ''"))
    tried = i.select(*key, F.posexplode(import_bases(F.concat("asked_from", F.lit("/x")), F.col("src"))).alias("n", "base"))
    by_path = tried.join(_by_base(paths), ["repo_id", "base"]).select(*key, F.lit(2).alias("rung"), (F.col("n") * len(CANDIDATE_ENDINGS) + F.col("rank")).alias("rank"), "path")
    far = i.where("src NOT LIKE '.%'")
    dotted = far.where("src LIKE '%.%'").select(*key, F.replace("src", F.lit("."), F.lit("/")).alias("tail"))
    by_tail = dotted.join(_by_tail(paths), ["repo_id", "tail"]).select(*key, F.lit(3).alias("rung"), "rank", "path")
    every = by_name.unionByName(by_path).unionByName(by_tail)
    best = keep(every.groupBy(*key).agg(F.min(F.struct("rung", "rank", "path")).alias("x")).select(*key, "x.path"))
    left = keep(far.join(best, key, "left_anti").withColumn("needle", F.replace("src", F.lit("."), F.lit("/"))))
    inside = containing(left.select("repo_id", "needle"), paths)
    by_part = keep(left.join(inside, ["repo_id", "needle"]).select(*key, "path"))
    stems = paths.select("repo_id", "path", F.get(F.split(F.element_at(F.split("path", "/"), -1), r"\."), F.lit(0)).alias("stem")).groupBy("repo_id", "stem").agg(F.min("path").alias("path"))
    plain = left.join(by_part, key, "left_anti").where("src NOT LIKE 'android.%' AND src NOT LIKE 'java.%' AND src NOT LIKE 'androidx.%'")
    stemmed = plain.select(*key, F.element_at(F.split(F.element_at(F.split("src", r"\."), -1), "/"), -1).alias("stem")).where("length(stem) >= 3")
    by_stem = stemmed.join(stems, ["repo_id", "stem"]).select(*key, "path")
    found = best.unionByName(by_part).unionByName(by_stem).withColumnRenamed("path", "target_path")
    answers = keep(asked.join(found, key).select(*same, "target_path"))
    return asking.join(answers, same, "left").select(*given, "target_path")


def import_rows(files: DataFrame) -> DataFrame:
    """repo_id, ord, file_path, k, source_module, is_relative, import_type of each import."""
    return files.select("repo_id", "ord", "file_path", F.posexplode("imports").alias("k", "i")).select("repo_id", "ord", "file_path", "k", "i.source_module", "i.is_relative", "i.import_type")


def is_internal(module: Column, relative: Column, packaged: Column) -> Column:
    starts = F.lit(False)
    for r in V.INTERNAL_ROOTS:
        starts = starts | module.startswith(r)
    return module.startswith(".") | F.coalesce(relative, F.lit(False)) | starts | packaged


def is_external(module: Column) -> Column:
    out = F.lit(False)
    for r in V.EXTERNAL_ROOTS:
        out = out | module.startswith(r)
    return out


def import_edges(resolved: DataFrame) -> DataFrame:
    """Resolved imports as edges, one for each (file, target, import type); edge_type says self, config or import."""
    d = resolved.where("target_path IS NOT NULL").groupBy("repo_id", "file_path", "target_path", "import_type").agg(F.min("ord").alias("ord"), F.min("k").alias("k"), F.count("*").alias("times"))
    kind = F.when(F.col("file_path") == F.col("target_path"), "SELF_IMPORT").when(P.is_config_file(F.col("target_path")) | P.is_config_file(F.col("file_path")), "CONFIG_REFERENCE").otherwise(F.col("import_type"))
    return d.withColumn("edge_type", kind)


def fan(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, file_path, fan_in, fan_out over source and dynamic imports (distinct source, target and type)."""
    e = edges.where(F.col("edge_type").isin(["SOURCE_IMPORT", "DYNAMIC_IMPORT"]))
    ends = e.select("repo_id", "file_path", F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("repo_id", "target_path", F.lit(0), F.lit(1)))
    sums = ends.groupBy("repo_id", "file_path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return files.select("repo_id", "ord", "file_path").join(sums, ["repo_id", "file_path"], "left").withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)).cast("long"), "fan_out": F.coalesce("fan_out", F.lit(0)).cast("long")})


def import_counters(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Attempts, resolutions, rate and status of a repository's imports, with self and duplicate counts."""
    packages = files.where("coalesce(package_name, '') <> ''").select("repo_id", F.explode(F.concat(F.array("package_name"), F.transform("defined_classes", lambda c: F.concat("package_name", F.lit("."), c)), "defined_classes")).alias("source_module")).distinct().withColumn("packaged", F.lit(True))
    d = resolved.join(packages, ["repo_id", "source_module"], "left").withColumn("internal", is_internal(F.col("source_module"), F.col("is_relative"), F.coalesce("packaged", F.lit(False))))
    hit = F.col("target_path").isNotNull()
    # imports without a target are counted where they are read; others become one row an edge, so no column is counted distinct
    edge = d.groupBy("repo_id", F.when(hit, F.col("file_path")).alias("file_path"), "target_path", F.when(hit, F.col("import_type")).alias("import_type")).agg(
        F.count("*").alias("n"), F.count_if("internal").alias("internal"), F.count_if(~hit & (F.col("internal") | ~is_external(F.col("source_module")))).alias("unresolved"),
    )
    c = edge.groupBy("repo_id").agg(
        F.sum("internal").alias("attempted"), F.coalesce(F.sum(F.when(hit, F.col("internal"))), F.lit(0)).alias("resolved"), F.sum("unresolved").alias("unresolved"),
        F.count_if(hit & (F.col("file_path") == F.col("target_path"))).alias("self_edges"), F.coalesce(F.sum(F.when(hit, F.col("n") - 1)), F.lit(0)).alias("duplicate_edges"),
    )
    total = F.when(F.col("attempted") > 0, F.col("attempted")).otherwise(F.col("resolved") + F.col("unresolved"))
    c = c.withColumn("attempted", total).withColumn("resolution_rate", F.when(total > 0, F.bround(F.col("resolved") / total, 4)).otherwise(1.0))
    return c.withColumn("status", quality_status(F.col("resolution_rate"), F.col("unresolved")))


def quality_status(rate: Column, unresolved: Column) -> Column:
    return F.when((rate >= 0.95) & (unresolved == 0), "HEALTHY").when(rate >= 0.70, "DEGRADED").otherwise("POOR")


def health_warnings(self_edges: Column, cycles: Column, status: Column, rate: Column, unresolved: Column) -> Column:
    percent = F.bround(rate * 100, 1).cast("string")
    return F.array_compact(F.array(
        F.when(self_edges > 0, F.format_string("Detected %d self-import statement(s).", self_edges)),
        F.when(cycles > 0, F.format_string("Found %d circular dependency cycle(s).", cycles)),
        F.when(status != "HEALTHY", F.format_string("Graph quality is %s (%s%% resolution rate, %d unresolved imports). Blast-radius confidence may be reduced.", status, percent, unresolved)),
    ))


def is_database(bases: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.exists(bases, lambda b: b.isin(V.DB_BASES) | F.lower(b).contains("model")), F.lit(False))


def knowledge_graph(files: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files without vendor files. Nodes are one row an id: files, symbols and routes as last
    defined, containers, bases, calls and packages as first met. Edges are a multigraph. Files that a repository's manifests and package files
    declare as entry points (declared: repo_id, classes, packages) have that role.
    """
    return graph_nodes(files, declared), graph_edges(files)


def _symbols(files: DataFrame, declared: DataFrame | None = None) -> SimpleNamespace:
    """What nodes and edges are both made of: files, classes, functions, and their bases and calls with the ids that they mean."""
    f = files.where(~P.is_generated_or_vendor(F.col("file_path")))
    entry = (None, None)
    if declared is not None:
        f = f.join(declared.select("repo_id", "classes", "packages"), "repo_id", "left")
        entry = (F.col("classes"), F.col("packages"))
    seg = F.split("file_path", "/")
    nested = F.size(seg) > 1
    f = f.withColumns({
        "module": F.when(nested, F.get(seg, F.lit(0))).otherwise("root"), "folder": F.when(nested, F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "/")).otherwise("."),
        "file_id": F.concat(F.lit("file:"), "file_path"), "role": P.file_role(F.col("file_path"), F.col("framework_signals"), *entry),
    })
    lit, c = F.lit, F.col
    classes = f.select("*", F.explode("class_symbols").alias("s")).withColumn("cid", F.concat(lit("class:"), "file_path", lit(":"), c("s.name"))).withColumn("db", is_database(c("s.base_classes"), c("s.is_db_model")))
    functions = f.select("*", F.explode("function_symbols").alias("s")).withColumn("fid", F.concat(lit("function:"), "file_path", lit(":"), c("s.name")))
    class_ids = classes.groupBy("repo_id", c("s.name").alias("name")).agg(F.min_by("cid", "ord").alias("known"))
    function_ids = functions.groupBy("repo_id", c("s.name").alias("name")).agg(F.min_by("fid", "ord").alias("known"))
    bases = classes.select("repo_id", "ord", "cid", "file_path", "module", F.explode("s.base_classes").alias("name")).join(class_ids, ["repo_id", "name"], "left").withColumn("target", F.coalesce("known", F.concat(lit("base:"), "name")))
    calls = functions.select("repo_id", "ord", "fid", "file_path", "module", F.explode(F.slice("s.calls", 1, 5)).alias("name")).join(function_ids, ["repo_id", "name"], "left").withColumn("target", F.coalesce("known", F.concat(lit("call:"), "name")))
    routes = f.select("*", F.explode("api_routes").alias("route"))
    packages = f.select("*", F.explode("package_deps").alias("pkg"))
    return SimpleNamespace(f=f, classes=classes, functions=functions, bases=bases, calls=calls, routes=routes, packages=packages)


def graph_nodes(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """The nodes of knowledge_graph(); they do not hang on what imports mean, so none is resolved for them."""
    s = _symbols(files, declared)
    f, classes, functions, bases, calls, routes, packages = (getattr(s, x) for x in ("f", "classes", "functions", "bases", "calls", "routes", "packages"))
    lit, c, no, none, seg = F.lit, F.col, F.lit(False), F.lit(None).cast("string"), F.split("file_path", "/")
    config, source_module = lit("CONFIGURATION"), lit("SOURCE_MODULE")
    critical = P.contains_any(F.lower("file_path"), V.CRITICAL_GRAPH)
    root = f.select("repo_id").distinct().withColumn("ord", lit(0).cast("long"))

    def node(d: DataFrame, id_: Column, label: Column, kind: Column, path: Column, module: Column, role: Column, critical: Column, first: bool) -> DataFrame:
        return d.select("repo_id", id_.alias("id"), F.struct((F.col("ord") if first else -F.col("ord")).alias("o"), label.alias("label"), kind.alias("kind"), path.alias("path"), module.alias("module"), role.alias("role"), critical.alias("is_critical")).alias("x"))

    nodes = [
        node(root, lit("repo:root"), lit("Repository Root"), lit("repository"), lit("."), none, config, no, True),
        node(f, F.concat(lit("module:"), "module"), c("module"), lit("module"), c("module"), c("module"), config, no, True),
        node(f.where("folder <> '.'"), F.concat(lit("folder:"), "folder"), F.element_at(F.split("folder", "/"), -1), lit("folder"), c("folder"), c("module"), config, no, True),
        node(f, c("file_id"), F.element_at(seg, -1), lit("file"), c("file_path"), c("module"), c("role"), critical, False),
        node(classes, c("cid"), c("s.name"), F.when(c("db"), "database").otherwise("class"), c("file_path"), c("module"), c("role"), c("db"), False),
        node(bases.where("known IS NULL"), c("target"), c("name"), lit("class"), c("file_path"), c("module"), source_module, no, True),
        node(functions, c("fid"), c("s.name"), lit("function"), c("file_path"), c("module"), c("role"), no, False),
        node(calls.where("known IS NULL"), c("target"), c("name"), lit("function"), c("file_path"), c("module"), source_module, no, True),
        node(routes, F.concat(lit("api:"), "route"), c("route"), lit("api"), c("file_path"), c("module"), lit("ROUTE"), lit(True), False),
        node(packages, F.concat(lit("package:"), "pkg"), c("pkg"), lit("package"), lit("package.json"), none, config, no, True),
    ]
    n = nodes[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    return n.groupBy("repo_id", "id").agg(F.min("x").alias("x")).select("repo_id", "id", "x.label", "x.kind", "x.path", "x.module", F.col("x.role").alias("file_classification"), "x.is_critical", F.abs("x.o").alias("ord"))


def graph_edges(files: DataFrame) -> DataFrame:
    """The edges of knowledge_graph(), those of resolved imports among them."""
    s = _symbols(files)
    f, classes, functions, bases, calls, routes, packages = (getattr(s, x) for x in ("f", "classes", "functions", "bases", "calls", "routes", "packages"))
    lit, c = F.lit, F.col
    container = F.when(c("folder") != ".", F.concat(lit("folder:"), "folder")).otherwise(F.concat(lit("module:"), "module"))

    def edge(d: DataFrame, source: Column, target: Column, relationship: Column, edge_type: Column) -> DataFrame:
        return d.select("repo_id", "ord", source.alias("source"), target.alias("target"), relationship.alias("relationship"), edge_type.alias("edge_type"))

    source = lit("SOURCE_IMPORT")
    resolved = resolve_imports(import_rows(f), f)
    edges = [
        edge(f.where("folder <> '.'"), F.concat(lit("module:"), "module"), F.concat(lit("folder:"), "folder"), lit("DEPENDS_ON"), lit("BUILD_DEPENDENCY")),
        edge(f, container, c("file_id"), lit("DEPENDS_ON"), lit("BUILD_DEPENDENCY")),
        edge(classes, c("file_id"), c("cid"), F.when(c("db"), "DEFINES_MODEL").otherwise("EXPORTS"), source),
        edge(bases, c("cid"), c("target"), lit("INHERITS"), source),
        edge(functions, c("file_id"), c("fid"), lit("EXPORTS"), source),
        edge(calls, c("fid"), c("target"), lit("CALLS"), source),
        edge(routes, c("file_id"), F.concat(lit("api:"), "route"), lit("DEFINES_ROUTE"), lit("ROUTE_REFERENCE")),
        edge(packages, c("file_id"), F.concat(lit("package:"), "pkg"), lit("IMPORTS"), lit("PACKAGE_DEPENDENCY")),
        edge(import_edges(resolved), F.concat(lit("file:"), "file_path"), F.concat(lit("file:"), "target_path"), lit("IMPORTS"), c("edge_type")),
    ]
    e = edges[0]
    for x in edges[1:]:
        e = e.unionByName(x)
    return e.withColumn("id", F.concat("source", F.lit("->"), "target"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("edge_type"), F.lit("")), F.nullif(F.col("relationship"), F.lit("")), F.lit("UNKNOWN"))
    return edges.groupBy(kind.alias("edge_type")).agg(F.count("*").alias("n"))


def totals(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id and how many parsed files, classes, functions and edges of the graph it has."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    f = files.where(~P.is_generated_or_vendor(F.col("file_path")))
    per = f.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.sum(size("class_symbols")).alias("total_classes"), F.sum(size("function_symbols")).alias("total_functions"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("total_dependencies"))
    return per.join(e, "repo_id", "left").withColumn("total_dependencies", F.coalesce("total_dependencies", F.lit(0)))


def discovered_modules(nodes: DataFrame) -> DataFrame:
    """Per module: nodes, summed fan_out, the first node's kind."""
    return nodes.where("module IS NOT NULL").groupBy("module").agg(F.count("*").alias("n_nodes"), F.sum("fan_out").alias("fan_out"), F.min_by("kind", "ord").alias("kind"))


def _sorted_runs(uri: str, batch: int = 1 << 16) -> Iterator[tuple[str | None, int, list[str]]]:
    """(repo_id, side, quoted ids) of the rows of a sorted file, in order, a batch at a time."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    with system.open_input_file(path) as f:
        for rows in pq.ParquetFile(f).iter_batches(batch, columns=["repo_id", "side", "quoted"]):
            repo, side, quoted = (rows.column(c) for c in range(3))
            ends = [(repo[k].as_py(), side[k].as_py()) for k in (0, len(repo) - 1)] if len(repo) else []
            if ends and ends[0] == ends[1]:  # in order, so all between are like both ends
                yield *ends[0], quoted.to_pylist()
            elif ends:
                for key, group in groupby(zip(repo.to_pylist(), side.to_pylist(), quoted.to_pylist()), lambda r: r[:2]):
                    yield *key, [r[2] for r in group]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo_id, graph_hash of rows (files, skip, least): the repositories of the first of the sorted files but for the one that has begun before
    it (least, if skip), the last of them on into the files behind; only a running digest and a batch are held.
    """
    out = []
    for batch in batches:
        for row in batch.to_pylist():
            now, digest, side, first, last = None, None, 0, True, None

            def end() -> None:
                if digest is not None:
                    digest.update(b"]}" if side else b'], "nodes": []}')
                    out.append({"repo_id": now[0], "graph_hash": digest.hexdigest()})

            for k, uri in enumerate(row["files"]):
                for repo, to, quoted in _sorted_runs(uri):
                    if k == 0:
                        last = repo
                        if row["skip"] and repo == row["least"]:
                            continue
                    elif repo != last:
                        break
                    if now != (repo,):
                        end()
                        now, digest, side, first = (repo,), hashlib.sha256(b'{"edges": ['), 0, True
                    if to != side:
                        digest.update(b'], "nodes": [')
                        side, first = to, True
                    digest.update((("" if first else ", ") + ", ".join(quoted)).encode())
                    first = False
            end()
    yield pa.RecordBatch.from_pylist(out, pa.schema([("repo_id", pa.string()), ("graph_hash", pa.string())]))


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, graph_hash: SHA-256 of the sorted ids as a JSON object with ', ' and ': ' separators; ids are escaped to ASCII.

    Ids are sorted in ranges, by all tasks, and written in order. A digest takes its letters in order, so one task streams a repository's ids
    from the files; it sorts and gathers none. The driver sees two rows a file.
    """
    spark = nodes.sparkSession
    ids = edges.select("repo_id", F.lit(0).alias("side"), "id").unionByName(nodes.select("repo_id", F.lit(1).alias("side"), "id")).where("id IS NOT NULL")
    quoted = F.concat(F.lit('"'), json_ascii(F.col("id")), F.lit('"')).alias("quoted")
    n, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ("repo_id", "side", "id")
    kept = keep(ids.repartitionByRange(n, *order).sortWithinPartitions(*order).select("repo_id", "side", quoted))
    found = kept.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("repo_id")).alias("lo"), F.max(F.struct("repo_id")).alias("hi")).collect()
    found = sorted(((x.file, x.lo.repo_id, x.hi.repo_id) for x in found), key=lambda x: x[0])
    rows = []
    for k, (file, lo, hi) in enumerate(found):
        skip = k > 0 and found[k - 1][2] == lo
        if not (skip and lo == hi):
            more = list(takewhile(lambda x: x[1] == hi, found[k + 1 :]))  # noqa: B023
            rows.append(([file, *(x[0] for x in more)], skip, lo))
    tasks = spark.createDataFrame(rows, "files array<string>, skip boolean, least string").repartition(max(1, min(n, len(rows))))
    return tasks.mapInArrow(_digests, "repo_id string, graph_hash string")


def json_ascii(text: Column) -> Column:
    """The letters of a JSON string in ASCII: quotes, backslashes and control characters escaped, others as \\uXXXX."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def letter(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(code(F.lit(55296) + F.shiftright(n - 65536, 10)), code(F.lit(56320) + (n - 65536) % 1024))
        return (
            F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(n == 10, "\\n").when(n == 13, "\\r").when(n == 9, "\\t").when(n == 8, "\\b").when(n == 12, "\\f")
            .when((n >= 32) & (n < 127), c).when(n < 65536, code(n)).otherwise(pair)
        )

    plain = text.rlike(r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$')
    return F.when(plain, text).otherwise(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), letter), ""))
