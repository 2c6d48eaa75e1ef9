"""Path predicates and classifiers as Column expressions: codegen only, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """Segments of a path, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(parts(path)), F.lit(0)), F.lit(""))


def suffix(path: Column) -> Column:
    """From the last dot of the name, unless that dot begins or ends it."""
    return F.regexp_extract(basename(path), r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def one_of(value: Column, values: list[str]) -> Column:
    return value.isin(values)


def ends_with_any(value: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | value.endswith(e)
    return out


def contains_any(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def has_part(segments: Column, names: list[str]) -> Column:
    return F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names]))


def is_generated_or_vendor(path: Column) -> Column:
    return contains_any(F.lower(slashed(path)), V.IGNORED_PATTERNS)


def is_config_file(path: Column) -> Column:
    return one_of(F.lower(F.element_at(F.split(slashed(path), "/"), -1)), V.PARSER_CONFIG_FILENAMES)


def normalize_path(path: Column) -> Column:
    """Slashes forward, '.' and empty segments dropped, '..' takes the segment before it along."""
    step = lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    segments = F.filter(F.split(slashed(path), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def file_type(path: Column) -> Column:
    """One of nine categories, first match first."""
    norm = F.lower(F.trim(slashed(path)))
    seg, name, ext = parts(norm), basename(norm), suffix(norm)
    gradle_like = one_of(ext, [".gradle", ".kts"]) & name.contains("build")
    return (
        F.when(ends_with_any(norm, V.BACKUP_EXTENSIONS) | name.startswith(".~"), "BACKUP")
        .when(has_part(seg, V.IDE_DIRS) | one_of(ext, V.IDE_SUFFIXES), "IDE_METADATA")
        .when(has_part(seg, V.OUTPUT_DIRS), "GENERATED")
        .when(one_of(ext, V.ASSET_EXTENSIONS), "ASSET")
        .when(one_of(ext, V.DOC_EXTENSIONS) | one_of(name, V.DOC_NAMES), "DOCUMENTATION")
        .when(has_part(seg, V.TEST_DIRS) | ends_with_any(name, V.TEST_ENDINGS), "TEST")
        .when(one_of(name, V.BUILD_FILENAMES) | gradle_like, "BUILD")
        .when(one_of(name, V.CONFIG_FILENAMES) | one_of(ext, V.DATA_SUFFIXES), "CONFIGURATION")
        .when(one_of(ext, V.SOURCE_EXTENSIONS) | name.contains("."), "SOURCE")
        .otherwise("CONFIGURATION")
    )


def is_relevant(path: Column) -> Column:
    return one_of(file_type(path), V.RELEVANT_TYPES)


def _in_example_dir(segments: Column) -> Column:
    dirs = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    marked = F.transform(dirs, lambda p, i: one_of(p, V.ROLE_EXAMPLE_DIRS) | ((p == "example") & ~F.coalesce(one_of(F.get(dirs, i - 1), V.ROLE_NAMESPACES), F.lit(False))))
    return F.exists(marked, lambda x: x)


def file_role(path: Column, signals: Column | None = None, manifest: Column | None = None, package_entrypoints: Column | None = None) -> Column:
    """Architectural role; signals, manifest and package_entrypoints are optional array columns."""
    norm = F.trim(slashed(path))
    low = F.lower(norm)
    seg, raw_name = parts(low), basename(norm)
    name, ext, base = basename(low), suffix(low), stem(low)
    source = one_of(ext, V.SOURCE_EXTENSIONS)
    never = F.lit(False)
    any_of = lambda words: F.coalesce(has_part(words, V.ROLE_SIGNALS), never)
    declared = never if manifest is None else F.coalesce(F.exists(manifest, lambda e: (F.lower(e) == base) | (F.lower(e) == name)), never)
    packaged = never if package_entrypoints is None else F.coalesce(F.exists(package_entrypoints, lambda e: (e == norm) | (e == raw_name) | (e == name)), never)
    test = has_part(seg, V.ROLE_TEST_DIRS) | ends_with_any(name, V.ROLE_TEST_ENDINGS) | (base.startswith("test_") & source) | (base.endswith("test") & one_of(ext, [".kt", ".java"]))
    config = one_of(name, V.CONFIG_FILENAMES) | one_of(name, V.BUILD_FILENAMES) | one_of(ext, V.ROLE_CONFIG_SUFFIXES) | (has_part(seg, ["alembic", "migrations"]) & one_of(ext, [".py", ".sql"])) | one_of(name, ["env.py", "alembic.ini", "__init__.py"])
    database = one_of(name, ["session.py", "database.py"]) & F.exists(seg, lambda p: p.contains("database") | p.contains("db"))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "SOURCE_MODULE")
        .when(ends_with_any(low, V.BACKUP_EXTENSIONS) | name.startswith(".~"), "GENERATED")
        .when(has_part(seg, V.ROLE_GENERATED_DIRS) | ends_with_any(name, V.ROLE_GENERATED_ENDINGS) | one_of(ext, V.ASSET_EXTENSIONS), "GENERATED")
        .when(has_part(seg, V.ROLE_DOC_DIRS) | one_of(ext, V.DOC_EXTENSIONS) | one_of(base, V.ROLE_DOC_STEMS), "DOCUMENTATION")
        .when(_in_example_dir(seg), "EXAMPLE")
        .when(test, "TEST")
        .when(has_part(seg, V.ROLE_SCRIPT_DIRS) | one_of(name, V.SCRIPT_FILENAMES) | one_of(ext, V.ROLE_SCRIPT_SUFFIXES), "CLI_SCRIPT")
        .when(config, "CONFIGURATION")
        .when(declared | packaged | ends_with_any(base, V.ROLE_COMPONENT_STEMS) | (any_of(signals) if signals is not None else never), "ENTRYPOINT")
        .when(one_of(name, V.ROLE_ROUTE_NAMES) | has_part(seg, V.ROLE_ROUTE_DIRS), "ROUTE")
        .when(one_of(name, V.FRAMEWORK_ENTRYPOINT_FILENAMES), F.when(database, "CONFIGURATION").otherwise("FRAMEWORK_ENTRYPOINT"))
        .when(one_of(raw_name, V.ENTRYPOINT_FILENAMES) | one_of(name, V.ENTRYPOINT_FILENAMES), "ENTRYPOINT")
        .when(has_part(seg, V.ROLE_WORKER_DIRS) & source, "FRAMEWORK_ENTRYPOINT")
        .when(one_of(base, V.ROLE_CLIENT_STEMS) & source, "ENTRYPOINT")
        .when(source | raw_name.contains("."), "SOURCE_MODULE")
        .otherwise("CONFIGURATION")
    )


def rule_matches(path: Column, markers: Column, extensions: Column, names: Column) -> Column:
    """Built-in rule match: by name, by suffix, by directory marker ('x/') or by a marker on a word boundary of the stem."""
    low = F.lower(slashed(path))
    full, base = F.concat(F.lit("/"), low), stem(low)
    words = F.split(base, "[_-]")
    marker = lambda m: F.when(m.endswith("/"), full.contains(F.concat(F.lit("/"), m))).otherwise(F.array_contains(words, m) | base.startswith(m) | base.endswith(m) | full.contains(F.concat(F.lit("/"), m, F.lit("/"))))
    return F.array_contains(names, basename(low)) | F.array_contains(extensions, suffix(low)) | F.exists(markers, marker)


def custom_rule_matches(path: Column, markers: Column, extensions: Column) -> Column:
    """Custom rule match: any marker within the path, any extension at its end."""
    low = F.lower(path)
    hit = lambda values, test: F.coalesce(F.exists(values, test), F.lit(False))
    return hit(markers, lambda m: low.contains(F.lower(m))) | hit(extensions, lambda e: low.endswith(F.lower(e)))


def is_safe_ref(ref: Column) -> Column:
    return F.coalesce((ref != "") & ~ref.contains("..") & ref.rlike(r"^[A-Za-z0-9_.~^/@{}\-]+$"), F.lit(False))


def impacted_module(path: Column, declared: list[str] | Column | None = None) -> Column:
    """The architectural module a changed path belongs to, null for none; declared modules, a list or an array column, go first,
    in their order.
    """
    norm = F.trim(slashed(path))
    kind, seg = file_type(norm), parts(norm)
    first, second = F.get(seg, F.lit(0)), F.get(seg, F.lit(1))
    top = F.lower(first)
    out = F.when(one_of(kind, ["IDE_METADATA", "ASSET", "GENERATED", "BACKUP"]) | (F.size(seg) == 0), F.lit(None).cast("string"))
    if declared is not None:
        names = declared if isinstance(declared, Column) else F.array(*[F.lit(m) for m in declared]).cast("array<string>")
        named = F.get(F.filter(names, lambda m: norm.startswith(F.concat(m, F.lit("/"))) | (norm == m) | norm.contains(F.concat(F.lit("/"), m, F.lit("/")))), F.lit(0))
        out = out.when(named.isNotNull(), F.concat(F.lit(":"), F.replace(named, F.lit("/"), F.lit(":"))))
    return (
        out.when(one_of(top, V.NESTED_MODULE_DIRS) & (F.size(seg) > 1), F.concat(top, F.lit("/"), second))
        .when(one_of(top, V.MODULE_DIRS), first)
        .when(one_of(kind, ["SOURCE", "TEST"]), F.when(F.size(seg) > 1, first).otherwise("root"))
        .when(kind == "BUILD", F.when(F.size(seg) > 1, first).otherwise("build"))
    )


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("test") | low.contains("spec")


# Language names by extension
LANGUAGES = {
    "kt": "Kotlin", "kts": "Kotlin Script", "java": "Java", "ts": "TypeScript", "tsx": "TypeScript (React)", "js": "JavaScript",
    "jsx": "JavaScript (React)", "cjs": "CommonJS", "mjs": "ES Module", "py": "Python", "json": "JSON", "md": "Markdown",
    "css": "CSS", "html": "HTML", "yml": "YAML", "yaml": "YAML", "sql": "SQL", "sh": "Shell", "rs": "Rust", "go": "Go",
    "txt": "Plain Text", "xml": "XML", "properties": "Properties",
}


def language_label(path: Column) -> Column:
    norm = slashed(path)
    ext = F.when(norm.contains("."), F.lower(F.element_at(F.split(norm, r"\."), -1))).otherwise("")
    out = F.when(ext == "", "Text")
    for k, name in LANGUAGES.items():
        out = out.when(ext == k, name)
    return out.otherwise(F.upper(ext))


def safe_filename(name: Column) -> Column:
    """ASCII only, anything but word characters, '-' and '.' an underscore, 64 characters at most."""
    ascii_only = F.regexp_replace(name, r"[^\x00-\x7F]", "")
    out = F.left(F.regexp_replace(ascii_only, r"[^\w\-.]", "_"), F.lit(64))
    return F.when(F.coalesce(out, F.lit("")) == "", "export").otherwise(out)


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{ name }} replaced; a name without a value is left to missing_variables()."""
    for name, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.regexp_replace(value, r"([\\$])", r"\\$1"))
    return template


def missing_variables(template: Column, known: list[str]) -> Column:
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), 1))
    return F.array_except(names, F.array(*[F.lit(k) for k in known]).cast("array<string>"))


def bucket_hash(key: Column) -> Column:
    """32-bit rolling hash whose product is taken in double precision and then wrapped, over UTF-16 letters of the BMP."""
    wrap = F.lit(4294967296.0)

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        signed = F.when(x >= 2147483648, x - 4294967296).otherwise(x)
        return F.pmod(signed.cast("double") * F.lit(16777619.0), wrap).cast("long")

    return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
