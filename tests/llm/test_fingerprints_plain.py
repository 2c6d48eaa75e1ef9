"""Fingerprints, edited texts and likeness from a version of their own, a byte at a time."""

import hashlib
import random
import zlib

import pytest

from faultline.llm import fingerprints

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def triggers(data):
    """The three rolling sums after each byte, added up, and 1: of the last seven bytes, of them by place, of them shifted by five bits a step."""
    window, out = [0] * 7, []
    for byte in data:
        window = [*window[1:], byte]
        by_place = sum((k + 1) * v for k, v in enumerate(window))
        shifted = sum(v << 5 * (6 - k) for k, v in enumerate(window))
        out.append((1 + sum(window) + by_place + shifted) % 2**32)
    return out


def letters(data, rolls, block):
    out, start = "", 0
    for k, r in enumerate(rolls):
        if r % block == 0 or k == len(data) - 1:
            letter = LETTERS[zlib.crc32(data[start : k + 1]) % 64]
            if not out.endswith(letter * 3):
                out += letter
            start = k + 1
    return out


def plain(text):
    data = text.encode()
    rolls = triggers(data)
    hits = lambda b: sum(r % b == 0 for r in rolls)
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and hits(block) < 32:
        block //= 2
    while len(letters(data, rolls, block)) > 128 and block < len(data):
        block *= 2
    return block, letters(data, rolls, block), letters(data, rolls, 2 * block)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(p, q):
    if p == q:
        return 1.0
    alike = lambda a, b: 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0
    if p[0] == q[0]:
        return max(alike(p[1], q[1]), alike(p[2], q[2]) if len(p[2]) + len(q[2]) >= 32 else 0.0)
    return alike(p[1], q[2]) if p[0] == 2 * q[0] else alike(p[2], q[1]) if 2 * p[0] == q[0] else 0.0


def texts():
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlü") for _ in range(r.randrange(2, 9))) for _ in range(n))
    base = prose(900)
    return ["", "a", "aaaa" * 400, "ab" * 900, "\x00\xff" * 30, prose(3), prose(40), base, base.replace("e", "é", 5), base[:3000] + prose(20) + base[3000:], prose(4000), "😀ß" * 200, base]


def test_fingerprint_by_bytes():
    for t in texts():
        block, one, two = plain(t)
        assert fingerprints.fingerprint(t) == f"{block}:{one}:{two}", t[:40]


def test_query_columns_by_hand(spark):
    rows = dict(enumerate(texts()))
    got = {x.doc_id: x for x in fingerprints.fingerprinted(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got.keys() == rows.keys()
    for k, t in rows.items():
        following = rows[k - 1] if k else rows[max(rows)]
        half = len(t) // 2
        change = t[: len(t) - half] + following[: min(half, len(following))]
        mine, other, after = plain(t), plain(change), plain(following)
        x = got[k]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(change.encode()).hexdigest())
        assert x.fingerprint == ":".join(map(str, mine)) and x.edited_fingerprint == ":".join(map(str, other))
        assert x.near_edited == pytest.approx(near(mine, other)) and x.near_next == pytest.approx(near(mine, after))
