"""Import resolution against a plain walk down the ladder; substring search against all pairs."""

import random

from faultline.operators import graph

FILES = "repo_id string, ord long, file_path string, package_name string, defined_classes array<string>"
IMPORTS = "repo_id string, ord long, file_path string, k int, source_module string"


def test_containing_against_all_pairs(spark):
    r = random.Random(2)
    part = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    files = [(f"r{k % 2}", "/".join(part() for _ in range(r.randrange(1, 5)))) for k in range(150)]
    needles = [(f"r{k % 3}", p[s : s + r.randrange(0, 12)]) for k in range(400) for _, p in [r.choice(files)] for s in [r.randrange(len(p))]] + [("r0", "zzzzzzzzz"), ("r0", "é")]
    got = {(x.repo_id, x.needle): x.path for x in graph.containing(spark.createDataFrame(needles, "repo_id string, needle string"), spark.createDataFrame(files, "repo_id string, path string")).collect()}
    want = {n: min(p for k, p in files if k == n[0] and n[1] in p) for n in needles if n[1] and any(k == n[0] and n[1] in p for k, p in files)}
    assert got == want
    assert len({len(n[1]) for n in want}) > 8


def plain(src, current, files, packages, aliases):
    """The target of one import; files are sorted, so the first that fits is the smallest."""
    clean = src.replace("\\", "/").strip()
    for name in (clean, clean.split(".")[-1]):
        if name in packages:
            return packages[name]
    for prefix, real in aliases:
        if clean.startswith(prefix):
            clean = real + clean[len(prefix) :]
            break
    if not clean:
        return None

    def tried(base):
        return next((base + e for e in graph.CANDIDATE_ENDINGS if base + e in files), None)

    if clean.startswith("@/"):
        for root in graph.ALIAS_ROOTS:
            if tried(root + clean[2:]):
                return tried(root + clean[2:])
    if clean.startswith("."):
        bare = clean.lstrip(".")
        dots = len(clean) - len(bare)
        rel = clean[2:] if clean.startswith("./") else "../" * (dots - 1) + bare
        out = []
        for seg in [*current.split("/")[:-1], *rel.split("/")]:
            if seg == ".." and out:
                out.pop()
            elif seg not in ("", ".", ".."):
                out.append(seg)
        return tried("/".join(out))
    if tried(clean.strip("/")):
        return tried(clean.strip("/"))
    path = clean.replace(".", "/")
    if "." in clean:
        if tried(path):
            return tried(path)
        for e in graph.DOTTED_ENDINGS:
            for f in files:
                if f == path + e or f.endswith("/" + path + e):
                    return f
    for f in files:
        if path in f:
            return f
    stem = clean.split(".")[-1].split("/")[-1]
    if len(stem) >= 3 and not clean.startswith(("android.", "java.", "androidx.")):
        for f in files:
            if f.split("/")[-1].split(".")[0] == stem:
                return f
    return None


def test_ladder(spark):
    r = random.Random(5)
    names = ["app", "core", "lib", "auth", "user", "login", "src", "index", "data"]
    files, imports, aliases = [], [], []
    for repo in ("one", "two", "three"):
        paths = sorted({"/".join(r.choice(names) for _ in range(r.randrange(1, 4))) + r.choice([".py", ".ts", ".kt", ".tsx", "/index.ts", ".md"]) for _ in range(60)})
        files += [(repo, k, p, "com.x." + p.split("/")[0] if p.endswith(".kt") else None, [f"C{k}"]) for k, p in enumerate(paths)]
        if repo != "three":
            aliases += [(repo, 2, "~", "src/"), (repo, 1, "~core", "core"), (repo, 3, "#", "./"), (repo, 4, "~a", "never")]
        for k in range(150):
            base = r.choice(paths)
            stem = base.rsplit(".", 1)[0]
            src = r.choice([base, stem, stem.replace("/", "."), "./" + stem.split("/")[-1], "../" + stem, ".." + stem.split("/")[-1], "@/" + stem, "~" + stem, "~core/" + stem, "#" + stem.split("/")[-1], stem[2:-1], "x." + stem.split("/")[-1], "java." + stem.split("/")[-1], f"C{k % 70}", "com.x.app", "nothing.at.all", "", " " + base + " "])
            imports.append((repo, k % len(paths), paths[k % len(paths)], k, src))
    a = spark.createDataFrame(aliases, "repo_id string, ord int, prefix string, replacement string")
    f = spark.createDataFrame(files, FILES)
    for alias in (a, None):
        got = {(x.repo_id, x.k): x.target_path for x in graph.resolve_imports(spark.createDataFrame(imports, IMPORTS), f, alias).collect()}
        assert len(got) == len(imports)
        for repo, _, current, k, src in imports:
            packages = {}
            for q, n, p, package, classes in files:
                if q == repo and package:
                    packages |= {package: p, **{f"{package}.{c}": p for c in classes}, **dict.fromkeys(classes, p)}
            mine = [(x, y) for _, _, x, y in sorted((n for n in aliases if n[0] == repo and alias is not None), key=lambda n: n[1])]
            want = plain(src, current, [p for q, _, p, _, _ in files if q == repo], packages, mine)
            assert got[repo, k] == want, (repo, src, current)
