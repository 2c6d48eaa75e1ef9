"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

_SPACE = r"[^\x20\x09-\x0D]"


def archives() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    twenty_bits = [f"CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT)" for g in range(8)]
    base32 = " || ".join(f"substr({letters}, (({v} >> {k}) & 31) + 1, 1)" for v in twenty_bits for k in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]+', '%20', 'g') AS url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, octet_length(encode(h)) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM f"""


def codes() -> str:
    """Codebooks by full search: every part against every entry."""
    distance = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(3):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (SELECT vec_id, a.p, b.e, {distance} AS d FROM parts a JOIN b{k} b ON a.p = b.p) GROUP BY 1, 2)")
        if k < 2:
            steps.append(f"m{k} AS (SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT a.p, a.e, c.i, floor(sum(a2.x[c.i])::DOUBLE / count(*))::BIGINT AS v FROM a{k} a JOIN parts a2 USING (vec_id, p) CROSS JOIN (SELECT unnest(range(1, 5)) AS i) c GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS x FROM k CROSS JOIN (SELECT unnest(range(16)) AS p)),
 b0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64) USING (vec_id)),
 {", ".join(steps)},
 coded AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1),
 book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id) CROSS JOIN book"""


def structure_repair() -> str:
    """The search as a recursion over turns, with whole audits and repaired texts in its four states."""
    byte = "lambda r, x: list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), {byte}), 4294967295)"
    none = "{'c': 1000000000, 'a': '', 'o': ''}"
    said = lambda x, role, text, first: f"{x}.o || {'' if first else 'chr(10) || '}{role} || ':' || {text}"
    edit = lambda x, cost, letter, out: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {out}}}"
    insert = lambda x, role, first=False: edit(x, 2, "I", said(x, f"'{role}'", "''", first))
    stay = lambda x, role, cost, letter, first=False: edit(x, f"({cost} + cut)", letter, said(x, role, "text", first))
    may = lambda when, x: f"CASE WHEN {when} THEN {x} ELSE {none} END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    closing = lambda source: f"(SELECT *, {least('t3', insert('s2', 'assistant'))} AS s3 FROM (SELECT * EXCLUDE (t2), {least('t2', insert('s0', 'user', True), insert('s1', 'user'), insert('t3', 'user'))} AS s2 FROM {source}))"
    go = [edit(f"s{k}", 3, "D", f"s{k}.o") for k in range(4)]
    kept, u, a = "NOT must_go", "NOT must_go AND initial = 'u'", "NOT must_go AND initial = 'a'"
    before = (("s0", True), ("s1", False), ("s3", False))
    new = [
        go[0],
        least(go[1], may("NOT must_go AND initial = 's'", stay("s0", "role", 0, "K", True))),
        least(go[2], *[may(u, stay(x, "role", 0, "K", f)) for x, f in before], *[may(kept, stay(x, "'user'", 2, "R", f)) for x, f in before]),
        least(go[3], may(a, stay("s2", "role", 0, "K")), may(kept, stay("s2", "'assistant'", 2, "R"))),
    ]
    start = "{'c': 0, 'a': '', 'o': ''}"
    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM keyed),
 damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
   CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE h <> 0),
 faulty AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (w) AS before, row_number() OVER (w) AS i, NOT regexp_matches(text, '{_SPACE}') AS blank,
   NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM damaged WINDOW w AS ({order})),
 seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM faulty),
 n AS MATERIALIZED (SELECT *, blank OR again AS must_go, CASE WHEN open AND NOT (blank OR again) THEN 1 ELSE 0 END AS cut FROM seen),
 path AS (SELECT conv_id, 0::BIGINT AS i, s0, s1, s2, s3 FROM {closing(f"(SELECT DISTINCT conv_id, {start} AS s0, {none} AS s1, {none} AS t2, {none} AS t3 FROM conversations)")}
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, s3 FROM {closing(f"(SELECT n.conv_id, n.i, {new[0]} AS s0, {new[1]} AS s1, {new[2]} AS t2, {new[3]} AS t3 FROM path JOIN n ON n.conv_id IS NOT DISTINCT FROM path.conv_id AND n.i = path.i + 1)")}),
 last AS (SELECT conv_id, {least("s0", "s3")} AS best FROM path QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
   count(*) FILTER (cut = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY 1)
 SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256 FROM last l LEFT JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


def all_statements() -> dict[str, str]:
    return {"op6_warc": archives(), "op11_structure_repair": structure_repair(), "op12_exact_dedup": EXACT_DEDUP, "op13_vector_codes": codes()}
