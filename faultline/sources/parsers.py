"""Source text to parsed-file facts: regular expressions on the JVM, and one Arrow kernel for Python's own grammar."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import fixed_values as V
from ..functions import paths as P

IMPORT = "struct<source_module:string,imported_name:string,alias:string,is_relative:boolean,import_type:string,line_number:int>"
NO_IMPORTS, NO_NAMES = f"array<{IMPORT}>", "array<string>"
CLASS_BASES = "array<struct<name:string,base_classes:array<string>>>"
# Language by suffix
LANGUAGE_OF = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".kt": "kotlin", ".kts": "kotlin", ".java": "java"}
SIGNALS = [
    ("Activity", ["AppCompatActivity", "ComponentActivity", "Activity()"]), ("ViewModel", ["ViewModel"]), ("BroadcastReceiver", ["BroadcastReceiver"]),
    ("Service", ["Service()", "IntentService"]), ("Jetpack Compose", ["@Composable"]), ("Room Database", ["@Entity", "@Database", "@Dao"]),
]
TS_IMPORT = r"(?m)^\s*import\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]"
TS_CLASS = r"(?m)\b(?:class|interface)\s+([A-Za-z_$][\w$]*)"
TS_FUNCTION = r"(?m)\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*[<(]"
TS_METHOD = r"(?m)^\s+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{;]+)?\{"
KEYWORDS = ["if", "for", "while", "switch", "catch"]


def language(path: Column) -> Column:
    """Parser of a path: null for vendor files, generic for configuration and unknown suffixes."""
    ext, out = P.suffix(F.lower(path)), F.when(P.is_generated_or_vendor(path), F.lit(None).cast("string")).when(P.is_config_file(path), "generic")
    for suffix, name in LANGUAGE_OF.items():
        out = out.when(ext == suffix, name)
    return out.otherwise("generic")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _by_line(text: Column, pattern: str, alias_group: int | None = None) -> Column:
    """Imports that match at the start of a line, with its number."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("m"), (F.regexp_extract(x, pattern, alias_group) if alias_group else F.lit("")).alias("a"), (i + 1).alias("line")))
    return F.transform(F.filter(lines, lambda s: s["m"] != ""), lambda s: F.struct(
        s["m"].alias("source_module"), F.element_at(F.split(s["m"], r"\."), -1).alias("imported_name"), F.nullif(s["a"], F.lit("")).alias("alias"), F.lit(False).alias("is_relative"), F.lit("SOURCE_IMPORT").alias("import_type"), s["line"].alias("line_number"),
    ))


def _first_of(imports: Column) -> Column:
    """The first import of each module."""
    return F.filter(imports, lambda s, i: F.array_position(F.transform(imports, lambda x: x["source_module"]), s["source_module"]) == i + 1)


def kotlin(files: DataFrame) -> DataFrame:
    """Kotlin facts of files (path, text): package, imports, classes with bases, functions, signals, tables, status."""
    t = F.col("text")
    d = files.withColumn("imports", _first_of(_by_line(t, V.KOTLIN_IMPORT, 2)))
    bases = lambda raw: F.transform(F.filter(F.transform(F.split(raw, ","), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != ""), lambda b: F.get(F.split(F.get(F.split(b, r"\("), F.lit(0)), "<"), F.lit(0)))
    d = d.withColumn("class_rows", F.zip_with(_all(t, V.KOTLIN_CLASS, 1), _all(t, V.KOTLIN_CLASS, 2), lambda n, b: F.struct(n.alias("name"), bases(b).alias("base_classes"))))
    names = F.transform("class_rows", lambda c: c["name"])
    d = d.withColumn("class_symbols", F.filter("class_rows", lambda c, i: F.array_position(names, c["name"]) == i + 1)).drop("class_rows")
    signals = F.array_compact(F.array(*[F.when(P.contains_any(t, words), name) for name, words in SIGNALS]))
    tables = F.array_distinct(_all(t, V.KOTLIN_TABLE))
    d = d.withColumns({
        "package_name": F.nullif(F.regexp_extract(t, V.KOTLIN_PACKAGE, 1), F.lit("")), "defined_classes": F.transform("class_symbols", lambda c: c["name"]),
        "defined_functions": F.array_distinct(_all(t, V.KOTLIN_FUN, 2)), "framework_signals": signals, "db_tables": F.when(t.contains("@Database"), F.concat(tables, F.array(F.lit("RoomDatabase")))).otherwise(tables),
    })
    nothing = (F.size("imports") == 0) & (F.size("defined_classes") == 0) & (F.size("defined_functions") == 0)
    return d.withColumn("parse_status", F.when(nothing & (F.length(F.trim(t)) > 20), "PARTIAL").otherwise("SUCCESS"))


def java(files: DataFrame) -> DataFrame:
    """Java facts of files (path, text): package, imports, classes, methods but control words."""
    t = F.col("text")
    return files.withColumns({
        "package_name": F.nullif(F.regexp_extract(t, V.JAVA_PACKAGE, 1), F.lit("")), "imports": _by_line(t, V.JAVA_IMPORT),
        "defined_classes": _all(t, V.JAVA_CLASS), "defined_functions": F.array_distinct(F.filter(_all(t, V.JAVA_METHOD), lambda m: ~m.isin(KEYWORDS))),
    })


#: Strings, templates and comments, without a repeated choice, which the JVM's matcher would nest for each letter.
TS_STRING = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""
TS_COMMENT = r"//[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
JSX_TEXT = r"(<[A-Za-z][\w.]*(?:\s[^<>]*)?>)[^<>{}]*(?=</)"


def typescript(files: DataFrame) -> DataFrame:
    """TypeScript and JavaScript facts of files (path, text): import sources, classes and interfaces, functions and methods. Comments
    count for nothing, strings and the text of JSX elements only as the sources of imports.
    """
    bare = F.regexp_replace("text", rf"({TS_STRING})|{TS_COMMENT}", "$1")
    code = F.regexp_replace(bare, TS_STRING, "''")
    t = F.when(F.lower("path").rlike(r"\.(tsx|jsx|js)$"), F.regexp_replace(code, JSX_TEXT, "$1")).otherwise(code)
    imports = F.transform(_all(bare, TS_IMPORT), lambda m: F.struct(m.alias("source_module"), m.alias("imported_name"), F.lit(None).cast("string").alias("alias"), m.startswith(".").alias("is_relative"), F.lit("SOURCE_IMPORT").alias("import_type"), F.lit(None).cast("int").alias("line_number")))
    methods = F.filter(_all(t, TS_METHOD), lambda m: ~m.isin([*KEYWORDS, "function"]))
    return files.withColumns({"imports": imports, "defined_classes": _all(t, TS_CLASS), "defined_functions": F.array_distinct(F.concat(_all(t, TS_FUNCTION), methods))})


def python_facts(texts: pd.Series, extended: pd.Series) -> pd.DataFrame:
    """Plain `import a.b` statements without alias (from-imports and aliases only if extended), classes, functions."""
    out = []
    for text, more in zip(texts, extended):
        imports, classes, functions, status = [], [], [], "SUCCESS"
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            tree, status = ast.Module([], []), "FAILED"
        for n in ast.walk(tree):
            row = lambda module, name, alias, rel, n=n: {"source_module": module, "imported_name": name, "alias": alias, "is_relative": rel, "import_type": "SOURCE_IMPORT", "line_number": n.lineno}
            if isinstance(n, ast.Import):
                imports += [row(a.name, a.name, a.asname, False) for a in n.names if more or not a.asname]
            elif isinstance(n, ast.ImportFrom) and more:
                imports += [row("." * n.level + (n.module or ""), a.name, a.asname, n.level > 0) for a in n.names]
            elif isinstance(n, ast.ClassDef):
                classes.append((n.lineno, n.name))
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                functions.append((n.lineno, n.name))
        imports.sort(key=lambda r: r["line_number"])
        out.append({"imports": imports, "classes": [x for _, x in sorted(classes)], "functions": [x for _, x in sorted(functions)], "status": status})
    return pd.DataFrame(out, columns=["imports", "classes", "functions", "status"])


_NAMES = ArrayType(StringType())
_IMPORT = StructType([
    StructField("source_module", StringType()), StructField("imported_name", StringType()), StructField("alias", StringType()),
    StructField("is_relative", BooleanType()), StructField("import_type", StringType()), StructField("line_number", IntegerType()),
])
PYTHON_FACTS = StructType([StructField("imports", ArrayType(_IMPORT)), StructField("classes", _NAMES), StructField("functions", _NAMES), StructField("status", StringType())])


def python(files: DataFrame, extended: bool = False) -> DataFrame:
    d = files.withColumn("f", pandas_udf(python_facts, PYTHON_FACTS)("text", F.lit(extended)))
    return d.select(*files.columns, "f.imports", F.col("f.classes").alias("defined_classes"), F.col("f.functions").alias("defined_functions"), F.col("f.status").alias("parse_status"))


def parse(files: DataFrame) -> DataFrame:
    """The columns of files (path, text and any others but text) with language, package_name, imports, defined_classes,
    defined_functions, framework_signals, package_deps, exports, db_tables, parse_status, class_symbols, function_symbols and
    api_routes, for all languages; vendor files drop out. Where a parser has no bases or calls the lists are empty.
    """
    from .readers import package_dependencies, package_scripts

    own = [c for c in files.columns if c != "text"]
    d = files.withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    names, imports = F.array().cast(NO_NAMES), F.array().cast(NO_IMPORTS)
    columns = {
        "package_name": F.lit(None).cast("string"), "imports": imports, "defined_classes": names, "defined_functions": names, "framework_signals": names, "package_deps": names, "exports": names,
        "db_tables": names, "parse_status": F.lit("SUCCESS"), "api_routes": names,
    }
    packaged = P.basename(F.col("path")) == "package.json"

    def generic(x: DataFrame) -> DataFrame:
        return x.withColumns({"package_deps": F.when(packaged, package_dependencies(F.col("text"))).otherwise(names), "exports": F.when(packaged, package_scripts(F.col("text"))).otherwise(names)})

    out = None
    for name, parser in (("python", python), ("typescript", typescript), ("kotlin", kotlin), ("java", java), ("generic", generic)):
        p = parser(d.where(F.col("language") == name))
        bases = F.col("class_symbols") if "class_symbols" in p.columns else F.transform("defined_classes", lambda c: F.struct(c.alias("name"), names.alias("base_classes"))) if "defined_classes" in p.columns else F.array().cast(CLASS_BASES)
        symbols = F.transform(bases, lambda c: F.struct(c["name"].alias("name"), c["base_classes"].alias("base_classes"), names.alias("methods"), F.lit(False).alias("is_db_model")))
        functions = F.transform(F.col("defined_functions") if "defined_functions" in p.columns else names, lambda f: F.struct(f.alias("name"), names.alias("calls")))
        p = p.select(*own, F.when(F.col("language") == "generic", "text").otherwise(F.col("language")).alias("language"), *[(F.col(c) if c in p.columns else v).alias(c) for c, v in columns.items()], symbols.alias("class_symbols"), functions.alias("function_symbols"))
        out = p if out is None else out.unionByName(p)
    return out


# Repository language by commonest suffix, frameworks by path
NAMES = {".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".cs": "C#"}
FRAMEWORKS = [("Next.js", ["next.config", "/app/"]), ("FastAPI", ["fastapi", "main.py"]), ("Node.js", ["package.json"]), ("Python", ["pyproject.toml"])]


def repository_language(files: DataFrame) -> DataFrame:
    """The language of the commonest suffix of files (ord, path); of equally common ones the first seen."""
    counts = files.withColumn("ext", P.suffix(F.lower("path"))).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counts.agg(F.max_by("ext", F.struct("n", -F.col("first"))).alias("ext"))
    out = F.when(F.col("ext").isNull(), F.lit(None).cast("string"))
    for k, v in NAMES.items():
        out = out.when(F.col("ext") == k, v)
    return best.select(out.otherwise(F.upper(F.substring("ext", F.lit(2), F.length("ext")))).alias("language"))


def frameworks(files: DataFrame) -> DataFrame:
    low = F.lower(P.slashed(F.col("path")))
    hits = F.array_compact(F.array(*[F.when(P.contains_any(low, words), name) for name, words in FRAMEWORKS]))
    return files.select(F.explode(hits).alias("framework")).distinct()
