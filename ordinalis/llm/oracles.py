"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_PET = "CASE WHEN pair_kind = 'pet' THEN lpad(lower(trim({0})), CAST(greatest(9, length(trim({0}))) AS INTEGER), '0') ELSE {0} END"

P1_FOUND = f"""
WITH RECURSIVE links AS (
    SELECT DISTINCT pair_kind AS kind, {_PET.format("key_a")} AS a, {_PET.format("key_b")} AS b
    FROM match_pairs WHERE is_match AND pair_kind IN ('pet', 'photo') AND key_a IS NOT NULL AND key_b IS NOT NULL),
ends AS (SELECT kind, a, b FROM links WHERE a <> b UNION SELECT kind, b, a FROM links WHERE a <> b),
reach AS (
    SELECT kind, a AS rec_key, b AS other FROM ends
    UNION
    SELECT r.kind, r.rec_key, e.b FROM reach r JOIN ends e ON e.kind = r.kind AND e.a = r.other)
SELECT kind, rec_key, min(least(rec_key, other)) AS group_key FROM reach GROUP BY kind, rec_key
"""


_ID = "lpad(lower(trim(PetID)), CAST(greatest(9, length(trim(PetID))) AS INTEGER), '0')"
_SPLIT = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}!-/:-@\[-`{-~]+"


def _shingles(name: str) -> str:
    return f"""SELECT id, d, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh
        FROM (SELECT DISTINCT {_ID} AS id, Description AS d, list_filter(regexp_split_to_array(lower(Description), '{_SPLIT}'), lambda x: x <> '') AS w
              FROM {name} WHERE Description IS NOT NULL AND PetID IS NOT NULL) WHERE len(w) >= 40"""


_ALIKE = "count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5"
_FLAT = "SELECT id, d, len(sh) AS n, unnest(sh) AS s FROM"
_PHOTO = r"""photo AS (SELECT path, folder, lpad(regexp_extract(base, '^(?:img[-_])?([0-9a-f]{1,9})[-_](\d+)(?:-copy| ?\(\d+\))*\.[a-z]+$', 1), 9, '0') AS pet,
    CAST(nullif(regexp_extract(base, '^(?:img[-_])?([0-9a-f]{1,9})[-_](\d+)(?:-copy| ?\(\d+\))*\.[a-z]+$', 2), '') AS HUGEINT) AS number
    FROM (SELECT path, regexp_extract(flat, '([^/]+)$', 1) AS base, regexp_extract(flat, '(?:^|/)(train|test)/', 1) AS folder FROM (SELECT DISTINCT path, lower(replace(path, '\', '/')) AS flat FROM image_index WHERE path IS NOT NULL)))"""

P3_FOUND = f"""
WITH tr AS ({_FLAT} ({_shingles("train")})), te AS ({_FLAT} ({_shingles("test")})),
texts AS (SELECT a.id AS x, b.id AS y FROM tr a JOIN te b USING (s) GROUP BY a.id, a.d, b.id, b.d HAVING {_ALIKE}),
{_PHOTO}
SELECT DISTINCT 'text' AS kind, least(x, y) AS key_a, greatest(x, y) AS key_b FROM texts
UNION ALL
SELECT DISTINCT 'photo', least(a.path, b.path), greatest(a.path, b.path) FROM photo a JOIN photo b ON a.pet = b.pet AND a.number = b.number WHERE a.folder = 'train' AND b.folder = 'test'
"""

_P4_PAIRS = f"""tr AS ({_FLAT} ({_shingles("train")})),
pairs AS (SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM tr a JOIN tr b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, a.d, b.id, b.d HAVING {_ALIKE})"""
P4_FOUND = f"WITH {_P4_PAIRS} SELECT x AS petid_a, y AS petid_b FROM pairs"

P4_GROUPS = f"""WITH RECURSIVE {_P4_PAIRS},
rec AS (SELECT DISTINCT id FROM ({_shingles("train")})),
ends AS (SELECT x AS a, y AS b FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT id AS a, id AS b FROM rec UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)
SELECT a AS petid, min(b) AS group_key, (SELECT count(*) FROM ends e WHERE e.a = reach.a) AS n_links FROM reach GROUP BY a"""


def _sourced(name: str) -> str:
    return f"""SELECT DISTINCT '{name}' AS split, {_ID} AS id, source, Description AS d FROM {name}
    WHERE Description IS NOT NULL AND PetID IS NOT NULL AND len(list_filter(regexp_split_to_array(lower(Description), '{_SPLIT}'), lambda x: x <> '')) >= 40"""


P3_REPORT = f"""
WITH tr AS ({_FLAT} ({_shingles("train")})), te AS ({_FLAT} ({_shingles("test")})),
alike AS (SELECT a.id AS x, a.d AS xd, b.id AS y, b.d AS yd FROM tr a JOIN te b USING (s) GROUP BY a.id, a.d, b.id, b.d HAVING {_ALIKE}),
hit AS (SELECT DISTINCT 'train' AS split, x AS id, xd AS d FROM alike UNION SELECT DISTINCT 'test', y, yd FROM alike),
rec AS (SELECT r.split, r.source, r.id, max(CAST(h.id IS NOT NULL AS INTEGER)) AS hit FROM ({_sourced("train")} UNION ALL {_sourced("test")}) r LEFT JOIN hit h ON h.split = r.split AND h.id = r.id AND h.d = r.d GROUP BY ALL),
{_PHOTO},
named AS (SELECT path, folder, pet, number, regexp_extract(lower(replace(path, '\\', '/')), '(?:train|test)/(?:(.+)/)?[^/]+$', 1) AS source FROM photo WHERE folder <> '' AND number IS NOT NULL),
both_ AS (SELECT a.path AS p, b.path AS q FROM named a JOIN named b ON a.pet = b.pet AND a.number = b.number WHERE a.folder = 'train' AND b.folder = 'test')
SELECT 'text' AS kind, split, source, count(*) AS n_records, CAST(sum(hit) AS BIGINT) AS n_overlapping FROM rec GROUP BY split, source
UNION ALL
SELECT 'photo', folder, source, count(*), count(*) FILTER (path IN (SELECT p FROM both_ UNION SELECT q FROM both_)) FROM named GROUP BY folder, source
"""

P5_FOUND = """
WITH raw AS (SELECT 'clip' AS encoder, path, img_emb FROM clip_img_emb UNION ALL SELECT 'siglip', path, img_emb FROM siglip_img_emb),
sized AS (SELECT encoder, path, list_transform(img_emb, lambda x: CAST(x AS DOUBLE)) AS v FROM raw WHERE img_emb IS NOT NULL AND len(img_emb) > 0),
good AS (SELECT encoder, path, any_value(v) AS v FROM sized WHERE list_dot_product(v, v) > 0 AND NOT isnan(list_dot_product(v, v)) AND NOT isinf(list_dot_product(v, v)) GROUP BY encoder, path),
unit AS (SELECT encoder, path, v, sqrt(list_dot_product(v, v)) AS n FROM good)
SELECT q.encoder, q.path, r.path AS near_path FROM unit q JOIN (SELECT DISTINCT path FROM probe_photos) p ON p.path = q.path JOIN unit r ON r.encoder = q.encoder AND r.path <> q.path
QUALIFY row_number() OVER (PARTITION BY q.encoder, q.path ORDER BY list_dot_product(q.v, r.v) / (q.n * r.n) DESC, r.path) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p5_found": P5_FOUND}
