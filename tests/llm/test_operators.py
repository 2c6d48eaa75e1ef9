"""Each corpus operator against a plain version of what it promises, and on odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import chat, fingerprints, line_dedup, mixing, near_dedup, packing, passages, quality_rules, queries, toxicity, warc
from faultline.llm.common import Scratch, connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fl_text string, fl_id long, target double, size int, lines int"
SF = "/root/testdata/sf0.001"
words = lambda n, seed, vocab=400: " ".join(f"w{random.Random(seed * 7919 + i).randrange(vocab)}" for i in range(n))


def docs_of(spark, rows):
    full = [(d, t, "en", s, len(t or ""), "x", 5, 0.5, 7, None) for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


ODD = [(1, None, "a"), (2, "", None), (None, "alone here", "a"), (3, " \t\n ", "b"), (4, words(3000, 1), "a"), (5, words(60, 2), "b"), (5, words(60, 2), "b"), (6, words(60, 2), None), (7, "ßé😀 " * 80, "é")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def simhash(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def closure(n, link):
    label = list(range(n))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    ids = sorted({v for e in edges if e[0] != e[1] for v in e})
    at, pairs = {v: k for k, v in enumerate(ids)}, {frozenset(e) for e in edges}
    want = closure(len(ids), lambda i, j: frozenset((ids[i], ids[j])) in pairs)
    assert got == {v: ids[want[at[v]]] for v in ids}


def test_maybe_wanted_keeps_all_wanted(spark):
    from faultline.llm.common import maybe_wanted

    rows = spark.range(20_000).withColumn("x", F.xxhash64("id")).withColumn("fl_row", F.lit(1))
    wanted = rows.where("id % 50 = 0").select("x")
    got = maybe_wanted(rows, "x", wanted, Scratch(spark, "t"))
    assert got.columns == rows.columns
    ids = {r.id for r in got.collect()}
    assert ids >= set(range(0, 20_000, 50)) and len(ids) < 500
    assert maybe_wanted(rows, "x", wanted.limit(0), Scratch(spark, "t")).count() == 0


def test_maybe_wanted_beyond_its_map(spark, monkeypatch):
    """With more wanted values than the largest map can tell apart all rows stay, and the exact join settles them."""
    from faultline.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 1 << 10)
    rows = spark.range(3000).withColumn("x", F.xxhash64("id"))
    assert common.maybe_wanted(rows, "x", rows.where("id % 5 = 0").select("x"), Scratch(spark, "t")).count() == 3000


def test_covering_masks_cover():
    masks, r = near_dedup.covering_masks(3, list(range(64)), 4), random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        flip = sum(1 << b for b in r.sample(range(64), r.randrange(0, 4)))
        assert any(m & flip == 0 for m in masks)


@pytest.mark.parametrize("split_above", [near_dedup.SPLIT_ABOVE, 8])
def test_near_links_whole(spark, split_above):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:6]:
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 4))) for _ in range(40)}
    fps = sorted(fps)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    scratch = Scratch(spark, "t")
    got = {x.node: x.root for x in connected_components(near_dedup.near_links(df, scratch, split_above=split_above), scratch).collect()}
    want = closure(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    groups = defaultdict(set)
    for k, v in zip(fps, want):
        groups[v].add(signed(k))
    mine = defaultdict(set)
    for k in map(signed, fps):
        mine[got.get(k, k)].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_components(spark, odd, none):
    got = near_dedup.near_components(odd, Scratch(spark, "t")).select("doc_id", near_dedup.fingerprint_hex("fp").alias("f"), "component_id").collect()
    assert Counter(x.f for x in got) == Counter(f"{simhash(t):016x}" for _, t, _ in ODD)
    by = {x.doc_id: x.component_id for x in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[None] is None and by[4] == 4
    kept = near_dedup.deduplicated(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns and Counter(x.doc_id for x in kept.collect()) == Counter([1, None, 4, 5, 7])
    assert near_dedup.near_components(none, Scratch(spark, "t")).count() == 0 and near_dedup.deduplicated(none, Scratch(spark, "t")).count() == 0


def plain_lines(rows):
    """Kept places by all pairs of distinct normalised lines, on edit similarity alone."""
    import regex

    norm = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip()
    places = sorted((d is None, d or 0, d, xxhash_row(d, t), k, norm(x)) for d, t in {(d, t) for d, t, _ in rows} if t is not None for k, x in enumerate(t.split("\n")) if norm(x))
    lines = sorted({p[-1] for p in places})
    group = dict(zip(lines, closure(len(lines), lambda i, j: alike(lines[i], lines[j]))))
    seen, gone = set(), defaultdict(set)
    for _, _, d, h, k, x in places:
        if group[x] in seen:
            gone[d, h].add(k)
        seen.add(group[x])
    return gone


def alike(x, y):
    most = int(0.2 * max(len(x), len(y)) + 1e-9)
    return abs(len(x) - len(y)) <= most and distance(x, y) <= most


def line_simhash(x):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in x.split(" ")]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def xxhash_row(d, t):
    h = xxhash.xxh64_intdigest((t or "").encode(), xxhash.xxh64_intdigest(("" if d is None else str(d)).encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (u != v))
    return row[-1]


def test_line_dedup(spark, none):
    base = [words(n, 50 + n) for n in (5, 9, 30, 60, 90)]
    edit = lambda s, k: s + f" w{k}"
    rows = [(1, "\n".join(base), "a"), (2, "\n".join([base[0].upper(), "", "--", edit(base[3], 1), "own line of two"]), "a"), (3, "\n".join([edit(base[4], 1), edit(base[4], 2), edit(base[4], 2) + "!"]), "b"), (4, None, "a"), (5, "", "a"), (None, base[2], "a"), (6, base[1] + "\nx", "b"), (6, base[1] + "\nx", "b")]
    got = line_dedup.deduplicated(docs_of(spark, rows), Scratch(spark, "t"), removed="gone").collect()
    gone = plain_lines(rows)
    assert len(got) == len(rows)
    for x in got:
        text = next(t for d, t, _ in rows if d == x.doc_id)
        drop = gone[x.doc_id, xxhash_row(x.doc_id, text)]
        assert set(x.gone or []) == drop and (x.fl_text, x.fl_id, x.size) == ("x", 5, 7)
        assert x.text == (None if text is None else "\n".join(v for k, v in enumerate(text.split("\n")) if k not in drop))
    assert line_dedup.deduplicated(none, Scratch(spark, "t")).count() == 0


def test_verified_lines(spark):
    r = random.Random(12)
    rows = []
    for _ in range(400):
        a = words(r.randrange(1, 25), r.randrange(9999), 30).split()
        b = [w for w in a if r.random() > 0.15]
        b = [r.choice(["zz", "w1"]) if r.random() < 0.1 else w for w in b] or ["q"]
        b.insert(r.randrange(len(b) + 1), "new")
        rows.append((" ".join(a), " ".join(b)))
    d = spark.createDataFrame([(f"a{k}", f"b{k}", a, b) for k, (a, b) in enumerate(rows)], "a string, b string, x string, y string")
    x = F.col("x")
    texts = d.select(F.col("a").alias("line_id"), x.alias("norm")).union(d.select("b", "y"))
    prints = line_dedup.prints_of(texts)
    found = {r.a for r in line_dedup.verified(d.select("a", "b"), texts, prints, Scratch(spark, "t")).collect()}
    near = lambda a, b: max(len(a), len(b)) <= line_dedup.MOST_LETTERS or (line_simhash(a) ^ line_simhash(b)).bit_count() <= line_dedup.RADIUS and distance(a.split(), b.split()) <= 0.6 * max(len(a.split()), len(b.split()))
    assert found == {f"a{k}" for k, (a, b) in enumerate(rows) if alike(a, b) and near(a, b)}
    assert sum(alike(a, b) and not near(a, b) for a, b in rows) <= 0.02 * len(rows)


def test_lines_of_one_block(spark):
    # 60 lines hold one common block; some groups of them are alike, all others are not
    common = words(12, 3)
    rows = []
    for k in range(60):
        own = words(10, 600 + k // 4, 100000).split()
        own[k % 4 * 2] = f"edit{k}"
        rows.append((k, common + " " + " ".join(own) if k % 2 else " ".join(own) + " " + common, "a"))
    gone = plain_lines(rows)
    got = line_dedup.deduplicated(docs_of(spark, rows), Scratch(spark, "t"), removed="gone").collect()
    found = {x.doc_id for x in got if x.gone}
    assert found <= {d for d, _ in gone} and len(found) >= 0.9 * len(gone)


def test_recall_of_lines(spark):
    cases = [(6, 1, 0.95), (10, 1, 0.98), (10, 2, 0.9), (20, 1, 1.0), (20, 3, 0.95), (40, 1, 1.0), (40, 6, 0.9), (80, 10, 0.95), (200, 20, 1.0)]
    r, rows, pairs = random.Random(7), [], []
    for n, edits, _ in cases:
        for k in range(80):
            base = words(n, 5000 + 97 * n + k + 1000 * edits, 100000).split()
            other = list(base)
            for i in r.sample(range(n), edits):
                other[i] = "x" + str(r.randrange(10000))
            pairs.append((len(rows), (n, edits), alike(" ".join(base), " ".join(other))))
            rows += [(len(rows), " ".join(base), "a"), (len(rows) + 1, " ".join(other), "a")]
    got = {x.doc_id for x in line_dedup.deduplicated(docs_of(spark, rows), Scratch(spark, "t"), removed="gone").collect() if x.gone}
    assert got <= {k + 1 for k, _, same in pairs if same}
    for n, edits, least in cases:
        want = [k + 1 for k, case, same in pairs if case == (n, edits) and same]
        assert len(want) > 40 and sum(k in got for k in want) >= least * len(want), (n, edits)


def test_recall_of_short_lines(spark):
    """One letter of one word changed, left out or put in, in lines of one to eight words; and a word more or less."""
    r, rows, pairs = random.Random(11), [], []
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9)))
    for n in range(1, 9):
        for k in range(80):
            base = [word() for _ in range(n)]
            other, i = list(base), r.randrange(n)
            at = r.randrange(len(base[i]))
            other[i] = base[i][:at] + r.choice(["#", "", "#" + base[i][at]]).replace("#", r.choice("aeiou")) + base[i][at + 1 :]
            if k % 10 == 0 and n > 4:
                other = [*base[:i], *base[i + 1 :]]
            pairs.append((len(rows), n, alike(" ".join(base), " ".join(other))))
            rows += [(len(rows), " ".join(base), "a"), (len(rows) + 1, " ".join(other), "a")]
    rows.append((len(rows), "\u4e2d" * 60 + "\n" + "\u6587" + "\u4e2d" * 60 + "\n" + "z" * 70 + "\n" + "z" * 69, "a"))
    got = {x.doc_id for x in line_dedup.deduplicated(docs_of(spark, rows), Scratch(spark, "t"), removed="gone").collect() if x.gone}
    for n in range(1, 9):
        want = [k + 1 for k, m, same in pairs if m == n and same]
        assert len(want) > 30 and sum(k in got for k in want) >= 0.95 * len(want), n
    assert not got & {k + 1 for k, _, same in pairs if not same}


def test_lines_whose_blocks_are_all_in_thousands(spark):
    """Lines of one long boilerplate and three words; in pairs of them the last and the first of the three differ, so no block is
    in fewer lines than all of them.
    """
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, rows = "please read the whole of this article before you write to us", []
    for k in range(1900):
        mine = word(34)
        for _ in range(2 if k < 120 else 1):
            rows.append((len(rows), f"{common} {word(4)} {mine} {word(4)}", "a"))
    got = {x.doc_id for x in line_dedup.deduplicated(docs_of(spark, rows), Scratch(spark, "t"), removed="gone").collect() if x.gone}
    assert got <= set(range(1, 240, 2)) and len(got) >= 0.9 * 120


def test_blocks_are_few():
    """Of a line of any length a bounded number counts."""
    most = line_dedup.WINDOWS + line_dedup.PARTS
    assert most <= 24 and line_dedup.MOST_LETTERS + 3 <= 64


def test_line_simhash_of_long_lines(spark):
    rows = [(1, words(70_000, 1, 90), "a"), (2, words(400, 2), "a")]
    texts = docs_of(spark, rows).select(F.col("doc_id").alias("line_id"), F.col("text").alias("norm"))
    got = {x.line_id: x.fp & ((1 << 64) - 1) for x in line_dedup.simhashes(texts).collect()}
    assert got == {d: line_simhash(t) for d, t, _ in rows}


def test_best_fit():
    r = random.Random(2)
    for limit, n in ((16, 300), (64, 200), (64, 5000), (1024, 400), (1024, 5000)):
        sizes = sorted((min(limit, 1 + int(r.expovariate(3 / limit))) for _ in range(n)), reverse=True)
        rooms = []
        for s in sizes:  # best-fit decreasing, one by one
            k = min((k for k, x in enumerate(rooms) if x >= s), key=lambda k: rooms[k], default=None)
            if k is None:
                rooms.append(limit - s)
            else:
                rooms[k] -= s
        places, n, steps = packing.best_fit(Counter(sizes), limit)
        assert n <= len(rooms) + (len(rooms) > 100) and steps < 8 * limit
        # every document in a place of its own, without holes
        rest, used = Counter(sizes), defaultdict(list)
        for size, runs in places.items():
            for (rank, first, offset), end in zip(runs, [r[0] for r in runs[1:]] + [rest[size]]):
                for i in range(end - rank):
                    used[first + i].append((offset, size))
        assert len(used) == n and sum(map(len, used.values())) == len(sizes)
        for row in used.values():
            at = 0
            for offset, size in sorted(row):
                assert offset == at
                at += size
            assert at <= limit


def test_packing(spark, odd, none):
    path = queries.tokenizer()
    got = packing.packed(odd, Scratch(spark, "t"), path, 128).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = Counter()
    for d, text, _ in ODD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        starts = packing.piece_starts(len(ids), 128)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[d, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.packed(none, Scratch(spark, "t"), path).count() == 0
    assert packing.piece_starts(1, 4) == [0] and packing.piece_starts(4, 4) == [0] and packing.piece_starts(9, 4) == [0, 1, 5]


def test_special_token_text():
    encode = packing.encoder(queries.tokenizer())
    assert encode("a<|endoftext|>b") == packing.encoder(queries.tokenizer())("a") + [50256] + encode("b")


def test_fingerprints(spark, odd, none):
    got = fingerprints.fingerprinted(odd).collect()
    h = lambda t: xxhash_of(t)
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1])))
    want = Counter()
    for k, (d, t, _) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        e = fingerprints.edited(t or "", nxt)
        want[d, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) for x in got) == want
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert fingerprints.fingerprinted(none).count() == 0
    assert fingerprints.fingerprinted(docs_of(spark, [(9, "only one", "a")])).first().near_next == 1.0


def xxhash_of(t):
    if t is None:
        return 42
    v = xxhash.xxh64_intdigest(t.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_is_local():
    a = words(2000, 9)
    b = a[:4000] + "XX" + a[4002:]
    x, y = fingerprints.fingerprint(a).split(":"), fingerprints.fingerprint(b).split(":")
    assert x[0] == y[0] and 0 < distance(x[1], y[1]) <= 3
    data = a.encode()
    plain = [i + 1 for i in range(len(data)) if (sum(data[i - j] * int(t) for j, t in enumerate(fingerprints.TAPS) if i >= j) + 1) % (1 << 32) % 48 == 0]
    assert fingerprints._cuts(data, 48)[0].tolist() == plain


def plain_statistics(text):
    w = (text or "").encode().split()
    dec = [x.decode() for x in w]
    win = Counter(tuple(dec[i : i + 3]) for i in range(len(dec) - 2))
    hit = {j for i in range(len(dec) - 2) if win[tuple(dec[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, dec)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, odd, none):
    rows = [*ODD, (8, "a b c d a b c\na b c\na b c\n| # x", "a"), (9, "x " * 400, "a"), (10, " a b c", "a")]
    got = quality_rules.with_statistics(docs_of(spark, rows)).collect()
    assert Counter((x.doc_id, x.fl_n_words, x.fl_word_chars, x.fl_n_symbols, x.fl_n_dup_lines, x.fl_n_repeat_words) for x in got) == Counter((d, *plain_statistics(t)) for d, t, _ in rows)
    assert quality_rules.with_statistics(none).count() == 0


def test_rules_are_learned(spark, none):
    good = [(k, words(80 + k % 40, k), "a") for k in range(200)]
    bad = [(1000 + k, " ".join(x + "###" for x in words(80, k).split()), "a") for k in range(60)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good] + [(d, 0) for d, _, _ in bad] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels, Scratch(spark, "t"))
    assert rules.rules
    kept = quality_rules.filtered(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, _, _ in good}
    assert quality_rules.filtered(none, labels, Scratch(spark, "t")).count() == 0
    assert quality_rules.fit(docs, labels.limit(0), Scratch(spark, "t")).rules == ()


def test_rule_steps_against_plain_ones():
    import math

    r = random.Random(9)
    for _ in range(20):
        rows = [({"a": r.randrange(6) / 2, "b": r.randrange(4) * 1.0}, r.random() < 0.4) for _ in range(60)]
        cut = {"a": [0.0, 0.5, 1.5, 2.5], "b": [1.0, 3.0]}
        counts = {f: sorted((k, sum(y for x, y in rows if sum(c <= x[f] for c in cut[f]) == k), sum(not y for x, y in rows if sum(c <= x[f] for c in cut[f]) == k)) for k in range(len(cut[f]) + 1)) for f in cut}
        share = lambda got: math.log2(sum(got) / len(got))
        gains = {}
        for f, v in cut.items():
            for c in v:
                for at_least in (False, True):
                    got = [y for x, y in rows if (x[f] >= c) == at_least]
                    gains[f, at_least, c] = sum(got) * (share(got) - share([y for _, y in rows])) if any(got) else 0.0
        found = quality_rules.best_condition(counts, cut, set())
        top = max(gains.values())
        assert found is None and top <= 1e-9 or gains[found.feature, found.at_least, found.threshold] == pytest.approx(top)
        if found is not None:
            other = quality_rules.best_condition(counts, cut, {(found.feature, found.at_least)})
            assert other is None or (other.feature, other.at_least) != (found.feature, found.at_least)
    assert quality_rules.pruned([(9, 3), (9, 1), (6, 1)]) == 2 and quality_rules.pruned([(0, 0), (0, 0)]) == 1 and quality_rules.pruned([(4, 0), (4, 0)]) == 1
    c = quality_rules.Condition
    assert quality_rules.with_condition((c("a", True, 0.5), c("b", False, 2.0)), c("a", True, 0.9)) == (c("a", True, 0.9), c("b", False, 2.0))


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.85), ("sf0.1", 0.95)])
def test_quality_verdict_on_held_out_labels(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0
    rules = quality_rules.fit(docs, labels.where(half), Scratch(spark, "t"))
    assert rules.rules
    stats = quality_rules.with_statistics(docs.select("doc_id", "text")).join(quality_rules.known_labels(labels.where(~half)), "doc_id")
    got = quality_rules.with_verdict(stats, rules).where("NOT fl_base_failed").groupBy("quality").agg(F.avg(F.col("fl_kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in got}
    assert kept[0] <= 1 - least and kept[1] >= 0.99


def test_warc_round_trip(spark):
    rows = [(k, f"http://a/{k}\r\nX: y", ("<p>" + words(50 + k % 3, k % 40)) if k % 11 else None) for k in range(400)] + [(400, None, ""), (None, "u", "<p>z"), (5, "http://a/5", "<p>" + words(52, 5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "t")
    files = scratch.keep(warc.write(pages, scratch.root + "/w"))
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if first.get(h or "", p) == p else first[h or ""]) for p, _, h in rows)
    for size in (997, 1 << 20):
        got = warc.read(spark, files, scratch.root, size, with_payload=True).collect()
        assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.refers_to) for x in got) == want
        assert all((x.record_type == "revisit") == (x.refers_to is not None) for x in got)
        assert all(warc.digest(bytes(x.payload)) == x.payload_digest for x in got if x.record_type == "response")
    assert warc.round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_warc_magic_inside_a_member():
    import os
    import tempfile

    path = tempfile.mkdtemp() + "/x.gz"
    inner = warc.record(7, "http://in", b"inner", None)
    parts = [warc.record(k, "http://a", os.urandom(300) + inner + warc.MAGIC * 5 + os.urandom(300), None) for k in range(40)]
    with open(path, "wb") as f:
        f.write(b"".join(parts))
    size, (system, _) = len(b"".join(parts)), warc.file_system(path)
    got = [h["x-page-id"] for s in range(0, size, 211) for h, _ in warc.records(system, path, s, min(size, s + 211), size)]
    assert got == [str(k) for k in range(40)]


def test_warc_foreign_and_damaged_records(spark, tmp_path):
    import zlib as z

    def member_of(raw):
        c = z.compressobj(6, z.DEFLATED, 31)
        return c.compress(raw) + c.flush()

    plain = lambda kind, block, more="": member_of(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://f\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    whole = [warc.record(k, "http://a", b"page %d" % k, None) for k in range(3)]
    wrong = plain("response", http + b"other", "WARC-Payload-Digest: sha1:" + warc.digest(b"it was") + "\r\n")
    parts = [plain("warcinfo", b"software: x"), whole[0], plain("request", b"GET / HTTP/1.1\r\n\r\n"), plain("response", http + b"no digest, no length"), plain("resource", b"bare"), wrong,
             plain("metadata", b"via: y"), member_of(b"WARC/1.0 and no more"), whole[1], whole[2][: len(whole[2]) - 20]]
    path = str(tmp_path / "f.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(parts))
    files = spark.createDataFrame([(path, sum(map(len, parts)))], "path string, bytes long")
    for size in (60, 1 << 20):
        got = warc.read(spark, files, str(tmp_path), size, with_payload=True).collect()
        assert Counter((x.page_id, x.record_type, bytes(x.payload)) for x in got) == Counter([(0, "response", b"page 0"), (1, "response", b"page 1"), (None, "response", b"no digest, no length"), (None, "resource", b"bare")])
        assert all(x.payload_digest == warc.digest(bytes(x.payload)) and x.payload_bytes == len(x.payload) for x in got)
        counts = {(x.status, x.record_type): x.n for x in warc.skipped(spark, files, str(tmp_path), size).collect()}
        assert counts == {("foreign", "warcinfo"): 1, ("foreign", "request"): 1, ("foreign", "metadata"): 1, ("damaged", "response"): 1, ("damaged", None): 2}


def test_toxicity(spark, odd, none):
    bad = ["vilewort", "grimsnark", "foulbeast"]
    r = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        w = words(r.randrange(40, 400), k, 5000).split()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), "a"))
        labels.append((k, int(k % 4 == 0)))
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), lambda d: d % 5 != 0)
    got = {x.doc_id: x for x in toxicity.scored(docs_of(spark, rows), model).collect()}
    held = [(got[d].predicted, y) for d, y in labels if d % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in toxicity.scored(odd, model).collect()) and toxicity.scored(odd, model).count() == len(ODD)
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.train(["a", "b"], [0, 0]).score("anything") < 0.5
    # every dictionary is one of zstandard's own, with tables, trained on whole windows: it holds words that both kinds have
    assert len(model.pairs) == toxicity.PAIRS and all(d[:4] == bytes.fromhex("37a430ec") for pair in model.pairs for d in pair)
    shared = {w.encode() for _, t, _ in rows for w in t.split()} - {b.encode() for b in bad}
    assert all(sum(w in d for w in shared) > 200 for pair in model.pairs for d in pair)
    # scores by hand: compressed lengths of every window, counted above the levels, through the logistic weights
    import math

    import zstandard

    for d, text, _ in rows[:25]:
        w = text.encode().lower().split()
        parts = [b" " + b" ".join(w[i : i + toxicity.WINDOW]) + b" " for i in range(0, len(w), toxicity.STRIDE)]
        length = lambda d, p: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)).compress(p))
        saved = [sum(length(o, p) - length(t, p) for o, t in model.pairs) for p in parts]
        z, n = [], len(parts)
        for level, rate in zip(model.levels, model.rates):
            z.append((sum(s >= level for s in saved) - n * rate) / math.sqrt(n * rate * (1 - rate) + 1))
        x = [1.0] + [math.log1p(max(v, 0)) for v in z] + [min(v, 0) for v in z]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(model.weights, x))))))
        assert abs(got[d].score - want) < 1e-9 and got[d].predicted == (want >= 0.5)


def test_toxicity_of_odd_tables(spark):
    """A doc_id with several texts, repeated rows, clashing columns, a very long text; texts too long to learn from still score."""
    rows = [(k, ("grimsnark " if k % 3 == 0 else "") + words(60, k, 300), "a") for k in range(90)]
    rows += [(3, "another text", "a"), (3, "another text", "a"), (500, words(60_000, 5, 300), "b"), (None, "grimsnark", "a")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(500, 1)], "doc_id long, toxic int")
    texts, kinds = toxicity.training_rows(docs_of(spark, rows), labels, lambda d: d >= 0)
    assert len(texts) == 90 and sum(kinds) == 30 and max(map(len, texts)) <= toxicity.LONGEST
    got = toxicity.scored(docs_of(spark, rows), toxicity.train(texts, kinds)).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, _, _ in rows) and len({x.score for x in got if x.doc_id == 3}) <= 2


def test_chat_linking(spark):
    rows = [(1, 0, "user", "Where is the red box?\nIt was here."), (1, 1, "assistant", "> Where is the RED box?\n\nOn the shelf."), (1, 2, "user", ">> Where is the red box?\n> On the shelf.\nThanks!"),
            (1, 3, "assistant", "> nothing like it\nok"), (2, 0, "user", "On the shelf."), (2, 1, "user", None), (2, 2, "user", "> On the shelf.\nsame"), (2, 3, "user", "> On the shelf."), (2, 3, "user", "> On the shelf."),
            (None, 1, "user", "> x"), (3, None, "user", "y"), (4, 0, "user", "same text"), (4, 5000, "user", "> same text\nlate"), (4, 5001, "user", "same text"), (4, 9999, "user", "> same text")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter((x.conv_id, x.turn, x.text, x.reply_to, x.thread_turn, x.depth) for x in chat.linked(df, Scratch(spark, "t")).collect())
    assert got == Counter([
        (1, 0, "Where is the red box?\nIt was here.", None, 0, 0), (1, 1, "On the shelf.", 0, 0, 1), (1, 2, "Thanks!", 1, 0, 2), (1, 3, "ok", None, 3, 0), (2, 0, "On the shelf.", None, 0, 0), (2, 1, "", None, 1, 0),
        (2, 2, "same", 0, 0, 1), (2, 3, "", 0, 0, 1), (2, 3, "", 0, 0, 1), (None, 1, "", None, 1, 0), (3, None, "y", None, None, 0), (4, 0, "same text", None, 0, 0), (4, 5000, "late", 0, 0, 1), (4, 5001, "same text", None, 5001, 0), (4, 9999, "", 5001, 5001, 1),
    ])
    assert chat.linked(df.limit(0), Scratch(spark, "t")).count() == 0


def test_threads_in_reply_order(spark):
    r = random.Random(21)
    rows, want = [], {}
    for conv in range(25):
        texts, parent = [], {}
        for turn in range(r.randrange(1, 14)):
            own = f"message {conv} number {turn} {words(4, conv * 50 + turn)}"
            lines = []
            if turn and r.random() < 0.75:
                p = r.randrange(turn)
                parent[turn] = p
                if r.random() < 0.5:
                    lines.append("On Monday, somebody wrote:")
                if p in parent and r.random() < 0.5:  # the quote's own quote, one level deeper
                    lines.append("> > " + texts[parent[p]])
                lines.append(("> " if r.random() < 0.5 else ">") + texts[p].upper())
            texts.append(own)
            rows.append((conv, turn, "user", "\n".join([*lines, own])))

        def walk(k, top, depth, found):
            found.append((k, top, depth, len(found)))
            for c in sorted(c for c in parent if parent[c] == k):
                walk(c, top, depth + 1, found)
            return found

        for k in range(len(texts)):
            if k not in parent:
                for turn, top, depth, place in walk(k, k, 0, []):
                    want[conv, turn] = (parent.get(turn), top, depth, place, texts[turn])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.linked(df, Scratch(spark, "t"))
    assert {(x.conv_id, x.turn): (x.reply_to, x.thread_turn, x.depth, x.place, x.text) for x in got.collect()} == want
    lines = [(x.conv_id, x.thread_turn, x.place) for x in chat.ordered(got, 3).collect()]
    assert lines == sorted(lines)
    chain = spark.createDataFrame([(1, k, "user", (f"> message {k - 1} of many\n" if k else "") + f"message {k} of many") for k in range(300)], "conv_id long, turn long, role string, text string")
    assert {x.turn: (x.depth, x.place) for x in chat.linked(chain, Scratch(spark, "t")).collect()} == {k: (k, k) for k in range(300)}


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        left -= sum(2 * sizes[s] for s in over)
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, odd, none):
    r = random.Random(8)
    rows = [(k, words(r.randrange(1, 200), k), r.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(1500)] + ODD
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, Scratch(spark, "t")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    want = plain_targets(sizes)
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(len((t or "").split()) for _, t, q in rows if q == s)
    again = mixing.mix(docs.repartition(5), Scratch(spark, "t")).collect()
    key = lambda x: (x.doc_id, x.source, x.size, x.taken)
    assert Counter(map(key, got)) == Counter(map(key, again))
    mixed = mixing.mixed_documents(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns and {x.target for x in mixed.collect()} == {0.5} and mixed.count() == sum(x.copies for x in got)
    assert mixing.mix(none, Scratch(spark, "t")).count() == 0


def plain_mix(rows, power, seed=9):
    """Copies of each (doc_id, text, source) by the book: certain ones, then Pareto order up to the size that comes nearest."""
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target, out = plain_targets(sizes), {}
    for s in sizes:
        mine = [(d, t, size(t), (size(t) ** power) if size(t) or power else 0.0) for d, t, q in rows if q == s]
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        need, sure = target[s] - whole * sizes[s], set()
        while True:
            open_ = sum(n * w for d, _, n, w in mine if d not in sure)
            level = max(0.0, need - sum(n for d, _, n, _ in mine if d in sure)) / open_ if open_ else 0.0
            more = {d for d, _, n, w in mine if d not in sure and level * w >= 1}
            if not more:
                break
            sure |= more
        rest, ranked = need - sum(n for d, _, n, _ in mine if d in sure), []
        for d, t, n, w in mine:
            if d not in sure and level * w > 0:
                h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash_pair(d, t))
                u = ((h if h < 1 << 63 else h - (1 << 64)) % (1 << 50) + 0.5) / (1 << 50)
                ranked.append((u / (1 - u) * (1 - level * w) / (level * w), d, n))
        for d, _, _, _ in mine:
            out[d] = whole + (d in sure)
        taken = 0
        for _, d, n in sorted(ranked):
            if taken >= rest or abs(taken + n - rest) > rest - taken:
                break
            out[d] += 1
            taken += n
    return out


def xxhash_pair(d, t):
    h = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(xxhash.xxh64_intdigest((t or "").encode(), 42).to_bytes(8, "little"), h)


@pytest.mark.parametrize("power", [0.0, 0.5, 2.0])
def test_mix_takes_the_documents_of_a_plain_one(spark, power):
    r = random.Random(18)
    rows = [(k, words(int(r.expovariate(1 / 60)) + 1 + 900 * (k % 97 == 0), k), r.choice(["a", "a", "a", "b", "c", "d", "e", None])) for k in range(700)]
    got = {x.doc_id: x.copies for x in mixing.mix(docs_of(spark, rows), Scratch(spark, "t"), power=power).collect()}
    want = plain_mix(rows, power)
    assert got == want and len(set(got.values())) > 1


def test_passages(spark, odd, none):
    common = words(80, 77, 100000)
    fuzzy = common.split()
    for k in (20, 45, 70):
        fuzzy[k] = "changed"
    rows = [(k, words(100, 300 + k, 100000) + " " + (common if k % 3 else " ".join(fuzzy)) + " " + words(50, 400 + k, 100000), "a") for k in range(12)]
    rows += [(50 + k, words(200, 900 + k, 100000), "a") for k in range(20)] + [(90, " ".join(common.split()[:30]) + " " + words(80, 950, 100000), "b")]
    got = passages.passages(docs_of(spark, rows), Scratch(spark, "t")).collect()
    assert {d for x in got for d in (x.a_doc_id, x.b_doc_id)} == set(range(12))
    joined = closure(12, lambda i, j: any({x.a_doc_id, x.b_doc_id} == {i, j} for x in got))
    assert set(joined) == {0}
    for x in got:
        assert x.similarity >= 0.9 and min(x.a_start, x.b_start) >= 98 and max(x.a_end, x.b_end) <= 182
    for d in range(12):
        spans = [(x.a_start, x.a_end) for x in got if x.a_doc_id == d] + [(x.b_start, x.b_end) for x in got if x.b_doc_id == d]
        assert set(range(102, 178)) <= {k for a, b in spans for k in range(a, b)}
    cleaned = passages.without_passages(docs_of(spark, rows), passages.passages(docs_of(spark, rows), Scratch(spark, "t")))
    assert {x.doc_id: len(x.text.split()) for x in cleaned.collect()}[5] <= 154
    assert {(x.a_doc_id, x.b_doc_id) for x in passages.passages(odd, Scratch(spark, "t")).collect()} == {(5, 6)}
    assert passages.passages(none, Scratch(spark, "t")).count() == 0


def test_chains_have_the_best_score():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, span in ((25, 60), (40, 60), (60, 200), (80, 400), (30, 5000)):
        a, b = rng.integers(0, span, n), rng.integers(0, span, n)
        best = {}
        for k in sorted(range(n), key=lambda i: (b[i], -a[i])):
            before = [s - passages.GAP_COST / 2 * (a[k] - a[j] + b[k] - b[j]) for j, s in best.items() if a[j] < a[k] and b[j] < b[k]]
            best[k] = 1 + max([0.0, *before])
        score, back = passages.best_scores(a, b)
        assert np.allclose(score, [best[k] for k in range(n)])
        assert all(a[j] < a[k] and b[j] < b[k] and abs(score[j] + 1 - passages.GAP_COST / 2 * (a[k] - a[j] + b[k] - b[j]) - score[k]) < 1e-9 for k, j in enumerate(back) if j >= 0)
        found = passages.chains(a, b)
        assert sorted(k for c in found for k in c) == list(range(n))
        for c in found:
            steps = list(zip(c, c[1:]))
            assert all(0 < a[k] - a[j] <= passages.GAP + passages.WORDS and 0 < b[k] - b[j] <= passages.GAP + passages.WORDS for j, k in steps)
    in_order = np.array([3, 9, 11, 200, 204])
    assert passages.chains(in_order, in_order + 7) == [[0, 1, 2], [3, 4]]


def test_passages_apart_are_all_found(spark):
    one, two = words(300, 31, 100000), words(100, 32, 100000)
    rows = [(0, f"{one} {words(400, 33, 100000)} {two}", "a"), (1, f"{one} {words(100, 34, 100000)} {two}", "a")]
    rows += [(2, f"{words(60, 35, 100000)} {words(60, 36, 100000)} {words(60, 37, 100000)}", "a"), (3, f"{words(60, 35, 100000)} {words(60, 38, 100000)} {words(60, 37, 100000)}", "a")]
    got = passages.passages(docs_of(spark, rows), Scratch(spark, "t")).collect()
    spans = {(x.a_doc_id, x.b_doc_id, x.a_start, x.a_end, x.b_start, x.b_end) for x in got}
    assert spans == {(0, 1, 0, 300, 0, 300), (0, 1, 700, 800, 400, 500), (2, 3, 0, 60, 0, 60), (2, 3, 120, 180, 120, 180)}


def test_passage_whose_fragments_lie_before_and_between(spark):
    common = words(120, 41, 100000).split()
    own = lambda k, n=30: words(n, 500 + k, 100000).split()
    rows = [(20, own(20) + common + own(21)), (60, own(60) + common + own(61))]
    # 20-word fragments that overlap by 10, in documents before both and in documents between them
    rows += [(base + k, own(100 + base + k) + common[10 * k : 10 * k + 20] + own(200 + base + k)) for base in (1, 30) for k in range(11)]
    # here the first place of each seed in the first document is a fragment's place, not the passage's
    other = words(120, 43, 100000).split()
    torn = [w for k in range(11, -1, -1) for w in other[10 * k : 10 * k + 20] + own(300 + k, 50)]
    rows += [(70, torn + other + own(71)), (80, own(80) + other + own(81))]
    got = passages.passages(docs_of(spark, [(d, " ".join(t), "a") for d, t in rows]), Scratch(spark, "t")).collect()
    spans = {(x.a_doc_id, x.b_doc_id): (x.a_start, x.a_end, x.b_start, x.b_end) for x in got}
    assert len(got) == 2 and spans == {(20, 60): (30, 150, 30, 150), (70, 80): (len(torn), len(torn) + 120, 30, 150)}


def test_passage_that_others_hold_in_part(spark):
    whole = words(60, 45, 100000).split()
    own = lambda k: words(40, 700 + k, 100000).split()
    rows = [(d, " ".join([*own(2 * d), *(whole[:42] if d % 2 else whole), *own(2 * d + 1)]), "a") for d in (1, 2, 3, 4)]
    got = passages.passages(docs_of(spark, rows), Scratch(spark, "t")).collect()
    assert [(x.a_doc_id, x.b_doc_id, x.a_start, x.a_end, x.b_start, x.b_end) for x in got] == [(2, 4, 40, 100, 40, 100)]


def test_passages_of_repeated_ids(spark):
    common = words(80, 46, 100000)
    rows = [(5, words(3, 47), "a"), (5, words(70, 48, 100000) + " " + common, "a"), (9, common + " end", "a"), (9, common + " end", "a"), (9, words(20, 49) + " " + common, "a"), (None, common, "a")]
    got = passages.passages(docs_of(spark, rows), Scratch(spark, "t")).collect()
    assert {(x.a_doc_id, x.b_doc_id, x.a_start, x.a_end) for x in got} == {(5, 9, 70, 150)} and {(x.b_start, x.b_end) for x in got} <= {(0, 80), (20, 100)}


def plain_alike(x, y):
    """The longest part of x, in words, that some part of y is alike to at 0.8, both of 50 words or more: edit distance of
    every part of x against all parts of y at once (a part of y may begin and end anywhere)."""
    best = 0
    for s in range(len(x) - 49):
        row = [0] * (len(y) + 1)
        start = list(range(len(y) + 1))
        for n, u in enumerate(x[s:], 1):
            new, at = [n], [0]
            for j, v in enumerate(y, 1):
                options = [(row[j - 1] + (u != v), start[j - 1]), (row[j] + 1, start[j]), (new[j - 1] + 1, at[j - 1])]
                e, f = min(options)
                new.append(e)
                at.append(f)
            row, start = new, at
            if n >= 50 and any(j - start[j] >= 50 and row[j] <= 0.2 * max(n, j - start[j]) for j in range(50, len(y) + 1)):
                best = max(best, n)
    return best


def test_passages_against_all_pairs(spark):
    r = random.Random(11)
    bank = [words(r.randrange(45, 80), 800 + k, 100000).split() for k in range(6)]
    rows = []
    for d in range(24):
        text = words(r.randrange(5, 40), 850 + d, 100000).split()
        for p in r.sample(bank, r.randrange(0, 3)):
            keep = [w if r.random() > 0.04 else f"edit{r.randrange(99999)}" for w in p]
            text += keep + words(r.randrange(5, 30), r.randrange(9999), 100000).split()
        rows.append((d, text))
    want = {(i, j) for i, x in rows for j, y in rows if i < j and plain_alike(x, y)}
    got = passages.passages(docs_of(spark, [(d, " ".join(t), "a") for d, t in rows]), Scratch(spark, "t")).collect()
    pairs = {(x.a_doc_id, x.b_doc_id) for x in got}
    text = dict(rows)
    assert pairs <= want and len(want) > 10
    for x in got:
        u, v = text[x.a_doc_id][x.a_start : x.a_end], text[x.b_doc_id][x.b_start : x.b_end]
        assert distance(u, v) <= x.edits and min(len(u), len(v)) >= 50 and x.similarity == pytest.approx(1 - x.edits / max(len(u), len(v))) and x.similarity >= 0.8
    joined = closure(24, lambda i, j: (min(i, j), max(i, j)) in pairs)
    assert sum(joined[i] == joined[j] for i, j in want) >= 0.9 * len(want)


def test_passages_of_many_documents(spark):
    """Two passages stand in 40 documents each, more than are tried with each other, and 60 of these share one of their own, too."""
    r = random.Random(8)
    fresh = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    both, one, two = fresh(120), fresh(70), fresh(70)
    rows = []
    for d in range(100):
        parts = [fresh(60)] + [list(p) for p, has in ((both, d < passages.FEW + 28), (one, d % 2 == 0), (two, d % 3 == 0)) if has]
        rows.append((d, " ".join(w for p in parts for w in p + fresh(30)), "a"))
    got = passages.passages(docs_of(spark, rows), Scratch(spark, "t")).collect()
    for mine in (set(range(passages.FEW + 28)), set(range(0, 100, 2)), set(range(0, 100, 3))):
        order = sorted(mine)
        near = {(x.a_doc_id, x.b_doc_id) for x in got} & {(a, b) for a in mine for b in mine}
        root = closure(len(order), lambda i, j: (order[j], order[i]) in near)
        assert len(set(root)) == 1


@pytest.mark.parametrize(("share", "least"), [(0.05, 1.0), (0.1, 0.95), (0.15, 0.95), (0.18, 0.9), (0.2, 0.9)])
def test_recall_of_edited_passages(spark, share, least):
    r = random.Random(int(share * 100))
    rows = []
    for k in range(60):
        base = words(80, 2000 + k, 100000).split()
        spots = r.sample(range(80), int(share * 80))
        other = [f"edit{r.randrange(99999)}" if i in spots else w for i, w in enumerate(base)]
        rows += [(2 * k, words(30, 3000 + k, 100000).split() + base), (2 * k + 1, other + words(30, 4000 + k, 100000).split())]
    got = passages.passages(docs_of(spark, [(d, " ".join(t), "a") for d, t in rows]), Scratch(spark, "t")).collect()
    pairs = {(x.a_doc_id, x.b_doc_id) for x in got}
    assert pairs <= {(2 * k, 2 * k + 1) for k in range(60)} and len(pairs) >= least * 60


def test_alignment():
    a = [w.encode() for w in words(90, 5, 9999).split()]
    b = a[:30] + [b"new"] + a[31:60] + a[62:]
    found = passages.blocks(a, b, [(10, 10), (40, 40), (75, 73)])
    assert passages.best_parts(found, 50, 0.8) == [(0, 90, 0, 88, 3)]
    assert all(x[1] == y[0] and x[3] == y[2] for x, y in zip(found, found[1:]))
    r = random.Random(3)
    for _ in range(60):
        x = [r.choice("abcd") for _ in range(r.randrange(0, 30))]
        y = [c for c in x if r.random() > 0.2] + [r.choice("abcd") for _ in range(r.randrange(0, 6))]
        assert passages.edits_between(x, y) == distance(x, y)
    assert passages.best_parts([(0, 60, 0, 60, 0), (60, 120, 60, 120, 60), (120, 150, 120, 150, 0)], 50, 0.8) == [(0, 60, 0, 60, 0)]


def test_runs_splits_big_groups():
    import pandas as pd

    from faultline.llm.common import runs

    frames = [pd.DataFrame({"k": [1, 2, 2]}), pd.DataFrame({"k": [2, 2, 2]}), pd.DataFrame({"k": [2, 3, 4, 4]}), pd.DataFrame({"k": [4, 5, 5, 5, 5]})]
    got = [(int(g["k"].iloc[0]), len(g), big) for g, big in runs(iter(frames), ["k"], 3)]
    assert Counter({k: sum(n for q, n, _ in got if q == k) for k in (2, 4, 5)}) == Counter({2: 6, 4: 3, 5: 4})
    assert {k: {b for q, _, b in got if q == k} for k in (2, 4, 5)} == {2: {True}, 4: {False}, 5: {True}}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns
    assert docs.count() > 0 and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
