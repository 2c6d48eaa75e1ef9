"""Readers: working trees, saved REST answers, manifests and build files as DataFrames."""

from __future__ import annotations

import json
import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions import fixed_values as V
from ..functions import paths as P

# Suffixes that count as supported source, and component tags of a manifest with their kinds
SUPPORTED = [".py", ".ts", ".tsx", ".js", ".jsx", ".kt", ".kts", ".java", ".json", ".gradle", ".toml", ".yaml", ".yml"]
COMPONENTS = [("activity", "activity"), ("service", "service"), ("receiver", "receiver"), ("provider", "provider"), ("activity-alias", "activity")]
ANDROID = "http://schemas.android.com/apk/res/android"


def working_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (relative to root), content, length, ord (path order is the listing's) of every file under root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    at = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    base = "/" + re.sub(r"^[a-z]+:/+", "", root).strip("/") + "/"
    return reader.load(root).select(F.substring(at, F.lit(len(base) + 1), F.length(at)).alias("path"), "content", "length")


def scan_counters(tree: DataFrame) -> DataFrame:
    """files_discovered (vendor files count), supported_source_files and the first manifest and settings file kept."""
    vendor = P.is_generated_or_vendor(F.col("path"))
    name = P.basename(F.col("path"))
    first = lambda test: F.min(F.when(test, F.col("path")))
    return tree.agg(
        F.count("*").alias("files_discovered"), F.count_if(~vendor & P.suffix(F.lower("path")).isin(SUPPORTED)).alias("supported_source_files"), F.count_if(~vendor).alias("kept_files"),
        first(name == "AndroidManifest.xml").alias("manifest_path"), first(name.isin("settings.gradle", "settings.gradle.kts")).alias("settings_path"),
    )


def gradle_modules(text: Column) -> Column:
    """Modules that include statements name, ':' as '/', each once in order."""
    one, two = F.regexp_extract_all(text, F.lit(V.GRADLE_INCLUDE), 1), F.regexp_extract_all(text, F.lit(V.GRADLE_INCLUDE), 2)
    raw = F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))
    clean = F.transform(raw, lambda m: F.replace(F.regexp_replace(m, r"^:+|:+$", ""), F.lit(":"), F.lit("/")))
    return F.array_distinct(F.filter(clean, lambda m: m != ""))


def package_dependencies(text: Column) -> Column:
    """Keys of dependencies, then of devDependencies, of a package.json."""
    keys = lambda field: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))
    return F.concat(keys("dependencies"), keys("devDependencies"))


def package_scripts(text: Column) -> Column:
    return F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")), F.array().cast("array<string>"))


def package_entrypoints(text: Column | str) -> Column:
    """Declared entry points of a package.json text, whole and by name, sorted; exports nest to any depth."""
    return pandas_udf(_entrypoints, ArrayType(StringType()))(text)


def _entrypoints(texts: pd.Series) -> pd.Series:

    def leaves(v):
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            for x in v.values():
                yield from leaves(x)

    def each(text):
        try:
            data = json.loads(text)
        except (TypeError, ValueError):
            return []
        if not isinstance(data, dict):
            return []
        clean = lambda v: v.lstrip("./").replace("\\", "/")
        named = [v for k in ("main", "module", "browser", "types", "typings") if isinstance(v := data.get(k), str) and v]
        bins, exports = data.get("bin"), data.get("exports")
        named += [bins] if isinstance(bins, str) and bins else [v for v in bins.values() if isinstance(v, str) and v] if isinstance(bins, dict) else []
        whole = [exports] if isinstance(exports, str) and exports else []
        named += [v for v in leaves(exports) if v] if isinstance(exports, dict) else []
        return sorted({clean(v) for v in named + whole} | {clean(v).split("/")[-1] for v in named})

    return texts.map(each)


def class_name(package: Column, name: Column) -> Column:
    """A manifest class name in full."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains(".") & (package != ""), F.concat(package, F.lit("."), name)).otherwise(name)


def _named(attribute: str) -> str:
    return f"@*[local-name()='{attribute}']"


PARSED = "package_name string, permissions array<string>, app string, parts array<struct<kind string, name string, exported boolean>>"


def _parsed_manifest(text: str | None) -> dict | None:
    """What a manifest says, from one parse: tags and attributes count by local name, attributes in order of their names; prefixes needn't
    be declared.
    """
    if not text:
        return None
    path, package, permissions, apps, found = [], [], [], [], {tag: [] for tag, _ in COMPONENTS}

    def start(tag, attributes):
        tag = tag.split(":")[-1]
        path.append(tag)
        own = sorted((k, v) for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:"))
        named = lambda name: [v for k, v in own if k.split(":")[-1] == name]
        if path == ["manifest"]:
            package.extend(named("package"))
        elif path == ["manifest", "uses-permission"]:
            permissions.extend(named("name"))
        elif path == ["manifest", "application"]:
            apps.extend(named("name"))
        elif len(path) == 3 and path[:2] == ["manifest", "application"] and tag in found:
            found[tag].append((named("name"), "true" in named("exported")))

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, lambda tag: path.pop()
    parser.Parse(text, True)
    parts = []
    for tag, kind in COMPONENTS:
        exported = {n for names, yes in found[tag] if yes for n in names}
        parts += [{"kind": kind, "name": n, "exported": n in exported} for names, _ in found[tag] for n in names]
    return {"package_name": (package + [""])[0], "permissions": permissions, "app": (apps + [None])[0], "parts": parts}


def _parsed_manifests(texts: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(("package_name", "permissions", "app", "parts"))
    return pd.DataFrame([_parsed_manifest(t) or none for t in texts], columns=list(none), dtype=object)


def manifest(files: DataFrame) -> DataFrame:
    """package_name, permissions, application_class, components, entrypoints of Android manifests (path, text), parsed once each; text
    that is no XML is an error, null or empty text has no lists.
    """
    d = files.withColumn("fl_parsed", pandas_udf(_parsed_manifests, PARSED)("text")).select("path", "fl_parsed.*").withColumn("package_name", F.coalesce("package_name", F.lit("")))
    own = F.when(F.coalesce("app", F.lit("")) != "", F.array(F.struct(F.lit("application").alias("kind"), class_name(F.col("package_name"), F.col("app")).alias("name"), F.lit(False).alias("exported"))))
    parts = F.transform("parts", lambda c: F.struct(c["kind"].alias("kind"), class_name(F.col("package_name"), c["name"]).alias("name"), c["exported"].alias("exported")))
    d = d.withColumn("components", F.concat(F.coalesce(own, F.array().cast("array<struct<kind:string,name:string,exported:boolean>>")), parts))
    full = F.transform("components", lambda c: c["name"])
    short = F.transform(F.filter("components", lambda c: c["kind"] != "application"), lambda c: F.element_at(F.split(c["name"], r"\."), -1))
    return d.select("path", "package_name", "permissions", F.when(F.col("app") != "", class_name(F.col("package_name"), F.col("app"))).alias("application_class"), "components", F.array_sort(F.array_distinct(F.concat(full, short))).alias("entrypoints"))


def manifest_filters(text: Column, tag: str) -> Column:
    """Action names of the intent filters of a component tag."""
    return F.xpath(text, F.lit(f"/manifest/application/{tag}/intent-filter/action/{_named('name')}"))


def log_commits(lines: DataFrame) -> DataFrame:
    """sha, short, author, date, message of '|'-separated log lines (ord, line); shorter lines drop out, and a message that
    holds '|' is cut there.
    """
    p = F.split("line", r"\|")
    return lines.where(F.size(p) >= 5).select("ord", *[F.get(p, F.lit(k)).alias(n) for k, n in enumerate(("sha", "short", "author", "date", "message"))])


def branches(lines: DataFrame) -> DataFrame:
    """name, is_default of `git branch` lines; '* ' marks the current one."""
    return lines.where(F.trim("line") != "").select("ord", F.trim(F.regexp_replace("line", r"^\* ", "")).alias("name"), F.col("line").startswith("* ").alias("is_default"))


def browse(listing: DataFrame, skip: list[str], limit: int = 200) -> DataFrame:
    """Visible entries of a listing (name, is_dir), by lower name."""
    return listing.where(~F.col("name").startswith(".") & ~F.col("name").isin(skip)).orderBy(F.lower("name"), "name").limit(limit)


def find_directories(listing: DataFrame, query: str, depth: int = 3, limit: int = 20) -> DataFrame:
    """Directories (path) less than `depth` levels down whose name contains the query."""
    seg = F.split("path", "/")
    return listing.where((F.size(seg) <= depth) & F.lower(F.element_at(seg, -1)).contains(query.lower())).orderBy("path").limit(limit)


class SavedAnswers(DataSource):
    """Saved JSON answers of a code host's REST interface: .format("saved_answers").option("kind", "repos").load(file).

    kind is repos, branches, commits, pulls or files; `filter` keeps repositories whose name or full name contains it.
    """

    # Columns by kind and where they are in an answer
    KINDS = {
        "repos": ("name string, full_name string, default_branch string, language string", ["name", "full_name", "default_branch", "language"]),
        "branches": ("name string, sha string", ["name", "commit.sha"]),
        "commits": ("sha string, message string, author string, date string", ["sha", "commit.message", "commit.author.name", "commit.author.date"]),
        "pulls": ("number int, title string, base string, head string, state string", ["number", "title", "base.ref", "head.ref", "state"]),
        "files": ("filename string, status string, previous_filename string", ["filename", "status", "previous_filename"]),
    }

    @classmethod
    def name(cls) -> str:
        return "saved_answers"

    def schema(self) -> str:
        return self.KINDS[self.options.get("kind", "repos")][0]

    def reader(self, schema) -> DataSourceReader:
        return SavedReader(self.options, self.KINDS[self.options.get("kind", "repos")][1])


class SavedReader(DataSourceReader):
    def __init__(self, options, fields):
        self.path, self.fields, self.filter = options["path"], fields, options.get("filter", "").lower()

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            data = json.load(f)
        for row in data.get("files", []) if isinstance(data, dict) else data:
            if self.filter and not any(self.filter in str(row.get(k, "")).lower() for k in ("name", "full_name")):
                continue
            out = []
            for field in self.fields:
                v = row
                for key in field.split("."):
                    v = v.get(key) if isinstance(v, dict) else None
                out.append(v)
            yield tuple(out)


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of the links of raw pages."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("pos", "href"))
