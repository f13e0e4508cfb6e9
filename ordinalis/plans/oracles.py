"""DuckDB statements for the queries of the core, written from the definitions, independent of the Spark plans."""

from __future__ import annotations

from ordinalis.functions import text as T
from ordinalis.plans.queries import AGE_EDGES

_S = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _id(c: str) -> str:
    return f"CASE WHEN length(trim({c})) < 9 THEN lpad(lower(trim({c})), 9, '0') ELSE lower(trim({c})) END"


def _latest(name: str, y: str) -> str:
    return f"""SELECT PetID, Description, AdoptionSpeed, source FROM (
        SELECT {_id("PetID")} AS PetID, Description, {y} AS AdoptionSpeed, source,
               row_number() OVER (PARTITION BY {_id("PetID")} ORDER BY loaded_at DESC, coalesce(Description, '') DESC) AS rn
        FROM {name} WHERE PetID IS NOT NULL) WHERE rn = 1"""


_BASE = f"""WITH tr AS ({_latest("train", "AdoptionSpeed")}), te AS ({_latest("test", "CAST(NULL AS INTEGER)")}),
both_ AS (SELECT *, 'train' AS split FROM tr UNION ALL SELECT *, 'test' AS split FROM te)"""
_TEXT = "coalesce(Description, '')"
_NORM = f"trim(regexp_replace(lower({_TEXT}), '{_S}+', ' ', 'g'))"
_LOW = f"regexp_replace(regexp_replace(translate(lower({_TEXT}), '０１２３４５６７８９', '0123456789'), '{_S}', ' ', 'g'), '[^\\P{{L}}a-zA-Z]|[^\\P{{N}}0-9]', '_', 'g')"


def _count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


_PHOTO = """photo AS (
    SELECT regexp_extract(stem, '^([0-9a-f]+)-(\\d+)$', 1) AS PetID, path, TRY_CAST(regexp_extract(stem, '^([0-9a-f]+)-(\\d+)$', 2) AS INTEGER) AS img_idx,
           regexp_extract(flat, '([^/]*)/[^/]*$', 1) AS split
    FROM (SELECT path, flat, regexp_replace(regexp_extract(flat, '([^/]*)$', 1), '(?i)\\.(?:jpg|jpeg|png)$', '') AS stem
          FROM (SELECT DISTINCT path, replace(path, '\\', '/') AS flat FROM image_index))
    WHERE regexp_matches(flat, '(?i)\\.(?:jpg|jpeg|png)$') AND regexp_matches(stem, '^[0-9a-f]+-\\d+$'))"""


def _vectors(encoder: str) -> str:
    return f"""(SELECT path, max(v) AS v FROM (SELECT path, CAST(img_emb AS DOUBLE[]) AS v, list_sum(list_transform(img_emb, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS q FROM {encoder}_img_emb)
    WHERE q > 0 AND NOT isnan(q) AND NOT isinf(q) GROUP BY path)"""


_VEC = f"vec AS {_vectors('clip')}"
_PHOTOS = f"{_PHOTO}, {_VEC}, photos AS (SELECT p.*, v.v FROM photo p LEFT JOIN vec v USING (path))"

_NUM = T.NUMBER
_WORD_VALUE = "CASE t " + " ".join(f"WHEN '{w}' THEN {float(v)}" for w, v in T.NUMBER_WORDS.items()) + " ELSE CAST(t AS DOUBLE) END"
_AGES = " UNION ALL ".join(f"SELECT PetID, split, unnest(regexp_extract_all(low, '{_NUM}\\s*(?:-|\\+|and a half)?\\s*{unit}\\b', 1)) AS t, {factor!r} AS f FROM low" for unit, factor in T.AGE_UNITS.items())
_PARSED = f""", low AS (SELECT PetID, split, {_LOW} AS low FROM both_),
ages AS (SELECT PetID, split, min(a) AS age_months FROM (SELECT PetID, split, ({_WORD_VALUE}) * f AS a FROM ({_AGES})) WHERE a > 0 AND a <= 240 GROUP BY PetID, split),
counts AS (SELECT PetID, split, max(c) AS pet_count FROM (SELECT PetID, split, {_WORD_VALUE} AS c FROM (SELECT PetID, split, unnest(regexp_extract_all(low, '{_NUM}\\s+(?:\\w+\\s+)?{T.COUNTED}\\b', 1)) AS t FROM low)) WHERE c >= 1 AND c <= 20 GROUP BY PetID, split)"""
_SCORED = f""", scored AS (SELECT *, CAST(least(greatest(round_even(score, 0), 1), 4) AS INTEGER) AS p FROM (
    SELECT PetID, AdoptionSpeed AS y, source, length({_TEXT}) AS n, 1 + 3 * (length({_TEXT}) % 97) / 96.0 AS score FROM tr WHERE AdoptionSpeed IS NOT NULL))"""


def _qwk(y: str, p: str) -> str:
    return f"2 * covar_pop({y}, {p}) / nullif(var_pop({y}) + var_pop({p}) + power(avg({y}) - avg({p}), 2), 0)"


def _bin(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} > {a:g} AND {v} <= {b:g} THEN '({a:g}, {b:g}]'" for a, b in zip(AGE_EDGES, AGE_EDGES[1:], strict=False)) + " END"


_BAG = """, bag AS (SELECT PetID, img_idx, path, v, row_number() OVER (PARTITION BY PetID ORDER BY img_idx, path) AS slot, count(*) OVER (PARTITION BY PetID) AS n FROM photos WHERE v IS NOT NULL)"""
_GATE = "(tanh(v[1]) / (1 + exp(-v[3])) - tanh(v[2]) / (1 + exp(-v[4])))"
_ATT = f"{_BAG}, att AS (SELECT *, e / sum(e) OVER (PARTITION BY PetID) AS w FROM (SELECT *, exp({_GATE} - max({_GATE}) OVER (PARTITION BY PetID)) AS e FROM bag WHERE slot <= 12))"


def _tfidf(rows: str, grams: str, min_df: int, cap: str = "") -> str:
    return f"""{_BASE}, docs AS ({rows}), g AS ({grams}),
    tf AS (SELECT PetID, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= {min_df} {cap}),
    raw AS (SELECT PetID, term, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS raw FROM tf JOIN df USING (term)),
    post AS (SELECT PetID, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY PetID)) AS weight FROM raw)"""


_CHAR = "SELECT PetID, substr(p, i, n) AS term FROM (SELECT PetID, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS i FROM (SELECT PetID, p, unnest([3, 4, 5]) AS n FROM (SELECT PetID, ' ' || unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) || ' ' AS p FROM docs)) WHERE length(p) >= n OR n = 3)"
_WORDS = "SELECT PetID, unnest(w) AS term FROM words UNION ALL SELECT PetID, w[i] || ' ' || w[i + 1] FROM (SELECT PetID, w, unnest(range(1, len(w))) AS i FROM words)"
_SUMMARY = "SELECT PetID, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM post GROUP BY PetID"
_DUP_DOCS = f"SELECT PetID, min(t) AS t FROM (SELECT PetID, {_NORM} AS t FROM both_) GROUP BY PetID"


def _dup(thresholds: str) -> str:
    head = _tfidf(_DUP_DOCS, _CHAR.replace("FROM docs", "FROM docs WHERE length(t) >= 5"), 2).replace("WITH tr", "WITH RECURSIVE tr", 1)
    return f"""{head},
    rep AS (SELECT t, min(PetID) AS rep FROM docs WHERE length(t) >= 5 GROUP BY t),
    member AS (SELECT d.PetID, r.rep FROM docs d JOIN rep r USING (t)),
    rp AS (SELECT p.* FROM post p JOIN rep r ON p.PetID = r.rep),
    sim AS (SELECT a.PetID AS a, b.PetID AS b, sum(a.weight * b.weight) AS sim FROM rp a JOIN rp b ON a.term = b.term AND a.PetID < b.PetID GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.9 - 1e-9),
    thr AS (SELECT unnest([{thresholds}]) AS threshold),
    edge AS (SELECT threshold, a, b FROM sim JOIN thr ON sim >= threshold - 1e-9 UNION SELECT threshold, b, a FROM sim JOIN thr ON sim >= threshold - 1e-9),
    reach AS (SELECT threshold, rep AS x, rep AS y FROM rep, thr UNION SELECT r.threshold, r.x, e.b FROM reach r JOIN edge e ON e.a = r.y AND e.threshold = r.threshold),
    label AS (SELECT threshold, x AS rep, min(y) AS grp FROM reach GROUP BY threshold, x),
    grouped AS (SELECT l.threshold, m.PetID, l.grp FROM member m JOIN label l USING (rep) UNION ALL SELECT threshold, PetID, PetID FROM docs, thr WHERE length(t) < 5)"""


_FOLDS = "SELECT PetID, CAST((row_number() OVER (PARTITION BY {y} ORDER BY md5('42-' || PetID), PetID) - 1) % 5 AS INTEGER) AS fold FROM {rows} WHERE {y} IS NOT NULL"
_KNN_OUT = "sum(power(z, 4) * y) / (sum(power(z, 4)) + 1e-9)"


def _text_knn() -> str:
    docs = f"SELECT split || ':' || PetID AS PetID, {_NORM} AS t FROM both_"
    return f"""{_tfidf(docs, _CHAR, 2)}, fold AS ({_FOLDS.format(y="AdoptionSpeed", rows="tr")}),
    meta AS (SELECT b.split || ':' || b.PetID AS id, b.AdoptionSpeed AS y, f.fold, length({_NORM}) >= 5 AS valid FROM both_ b LEFT JOIN fold f ON f.PetID = b.PetID AND b.split = 'train'),
    sim AS (SELECT q.PetID AS q, r.PetID AS r, round(sum(q.weight * r.weight), 9) AS sim FROM post q JOIN post r ON q.term = r.term AND q.PetID <> r.PetID JOIN meta m ON m.id = r.PetID AND m.y IS NOT NULL AND m.valid JOIN meta n ON n.id = q.PetID
            WHERE n.fold IS NULL OR m.fold IS NULL OR n.fold <> m.fold GROUP BY ALL),
    near AS (SELECT q, m.y, least(sim, 1) AS z, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS rn FROM sim JOIN meta m ON m.id = r WHERE sim > 0 QUALIFY rn <= 5),
    per AS (SELECT q, {_KNN_OUT} AS knn_y, CAST(min_by(y, rn) AS DOUBLE) AS nn1_y, max(z) AS nn1_sim, sum(z) / 5 AS knn_mean_sim FROM near GROUP BY q)
    SELECT id, CASE WHEN valid THEN round(coalesce(knn_y, 0), 6) END AS knn_y, CASE WHEN valid THEN nn1_y END AS nn1_y, round(coalesce(nn1_sim, 0), 6) AS nn1_sim, round(coalesce(knn_mean_sim, 0), 6) AS knn_mean_sim FROM meta LEFT JOIN per ON q = id"""


def _two_blocks() -> str:
    grams = "SELECT PetID, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS i FROM (SELECT PetID, p, unnest([2, 3, 4, 5]) AS n FROM (SELECT PetID, ' ' || unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) || ' ' AS p FROM docs)) WHERE length(p) >= n OR n = 2"
    return f"""{_BASE}, latest AS (SELECT split || ':' || PetID AS PetID, min(Description) AS Description FROM both_ GROUP BY ALL), docs AS (SELECT PetID, lower({_TEXT}) AS m, {_NORM} AS t FROM latest),
    words AS (SELECT PetID, regexp_extract_all(m, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM docs),
    g AS (SELECT PetID, 'c' AS block, substr(p, i, n) AS term FROM ({grams}) UNION ALL SELECT PetID, 'w', term FROM ({_WORDS})),
    tf AS (SELECT PetID, block, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT block, term, count(*) AS df FROM tf GROUP BY block, term HAVING count(*) >= CASE block WHEN 'c' THEN 5 ELSE 3 END QUALIFY row_number() OVER (PARTITION BY block ORDER BY sum(tf) DESC, term) <= CASE block WHEN 'c' THEN 80000 ELSE 50000 END),
    raw AS (SELECT PetID, block, term, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS raw FROM tf JOIN df USING (block, term)),
    post AS (SELECT PetID, block, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY PetID, block)) AS weight FROM raw)
    SELECT PetID AS id, block || ':' || term AS term, df, round(weight, 6) AS weight FROM post"""


def _bundles() -> str:
    parts, columns = [], []
    for tag, size in (("clip", 64), ("siglip", 48)):
        pools = [(f"{tag}_zs_slot_{s}_{a}", s, a) for s in (1, 2, 3) for a in ("first", "mean", "max")]
        near = ["knn_y", "nn1_y", "nn1_sim", "knn_mean_sim"]
        columns += [*(f"round({c}, 6) AS {c}" for c, _, _ in pools), *(f"round({tag}_img_{c}, 6) AS {tag}_img_{c}" for c in near)]
        how = {"first": "arg_min(p, (img_idx, path))", "mean": "avg(p)", "max": "max(p)"}
        parts.append(f"""{tag}_v AS (SELECT p.*, v.v, list_transform(v.v, lambda x: x / sqrt(list_dot_product(v.v, v.v))) AS u, least(greatest(p.img_idx, 1), 3) AS slot FROM photo p JOIN {_vectors(tag)} v USING (path)),
        {tag}_c AS (SELECT slot, i, avg(x) AS c FROM (SELECT slot, unnest(u) AS x, unnest(range(0, {size})) AS i FROM {tag}_v WHERE slot IS NOT NULL) GROUP BY slot, i),
        {tag}_m AS (SELECT slot, list(c / l ORDER BY i) AS m FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY slot)) AS l FROM {tag}_c) GROUP BY slot),
        {tag}_z AS (SELECT v.PetID, v.img_idx, v.path, m.slot, 100 * list_dot_product(v.u, m.m) AS z FROM {tag}_v v, {tag}_m m),
        {tag}_e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY path)) AS e FROM {tag}_z),
        {tag}_p AS (SELECT *, e / sum(e) OVER (PARTITION BY path) AS p FROM {tag}_e),
        {tag}_w AS (SELECT PetID, {", ".join(f"{how[a]} FILTER (slot = {s}) AS {c}" for c, s, a in pools)} FROM {tag}_p GROUP BY PetID),
        {tag}_a AS (SELECT PetID, list(m / l ORDER BY i) AS m FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY PetID)) AS l FROM (SELECT PetID, i, avg(x) AS m FROM (SELECT PetID, unnest(v) AS x, unnest(range(0, {size})) AS i FROM {tag}_v) GROUP BY PetID, i)) GROUP BY PetID),
        {tag}_k AS (SELECT q.PetID, l.y, round(list_dot_product(q.m, r.m), 9) AS sim, row_number() OVER (PARTITION BY q.PetID ORDER BY round(list_dot_product(q.m, r.m), 9) DESC, r.PetID) AS rn
            FROM {tag}_a q JOIN listing o ON o.PetID = q.PetID JOIN listing l ON l.y IS NOT NULL AND (o.fold IS NULL OR o.fold <> l.fold) JOIN {tag}_a r ON r.PetID = l.PetID QUALIFY rn <= 5),
        {tag}_n AS (SELECT PetID, {_KNN_OUT} AS {tag}_img_knn_y, CAST(min_by(y, rn) AS DOUBLE) AS {tag}_img_nn1_y, max(z) AS {tag}_img_nn1_sim, avg(z) AS {tag}_img_knn_mean_sim FROM (SELECT *, greatest(least(sim, 1), 0) AS z FROM {tag}_k) GROUP BY PetID)""")
    return f"""{_BASE}, {_PHOTO}, pet AS (SELECT PetID, max(AdoptionSpeed) AS y FROM both_ GROUP BY PetID), fold AS ({_FOLDS.format(y="y", rows="pet")}),
    listing AS (SELECT pet.*, fold.fold FROM pet LEFT JOIN fold USING (PetID)), {", ".join(parts)}
    SELECT l.PetID, {", ".join(columns)} FROM listing l {" ".join(f"LEFT JOIN {t}_{x} USING (PetID)" for t in ("clip", "siglip") for x in "wn")}"""


def _ridge_one(alpha: float = 3.0) -> str:
    return f"""{_BASE}, pet AS (SELECT PetID, max(AdoptionSpeed) AS y FROM both_ GROUP BY PetID), fold AS (SELECT PetID, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42-' || PetID), PetID) - 1) % 5 AS INTEGER) AS fold FROM pet),
    x AS (SELECT PetID, min(length({_TEXT})) AS x FROM both_ GROUP BY PetID HAVING count(DISTINCT length({_TEXT})) >= 1),
    r AS (SELECT pet.PetID, y, fold, CAST(x AS DOUBLE) AS x FROM pet JOIN fold USING (PetID) JOIN x USING (PetID)),
    m AS (SELECT f.f, avg(y) AS ym, avg(x) AS xm, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + {alpha}) AS b FROM r, range(5) f(f) WHERE y IS NOT NULL AND fold <> f.f GROUP BY f.f)
    SELECT PetID, CASE WHEN y IS NOT NULL THEN fold END AS fold, round(avg(ym + b * (x - xm)), 6) AS pred FROM r JOIN m ON y IS NULL OR m.f = r.fold GROUP BY PetID, y, fold"""


_BOX = """SELECT split, '{c}' AS feature, any_value(n) AS n, any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(v) AS low, max(v) AS high
    FROM (SELECT split, v, count(*) OVER w AS n, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.5) OVER w AS m, quantile_cont(v, 0.75) OVER w AS q3 FROM (SELECT split, CAST({c} AS DOUBLE) AS v FROM feat) WINDOW w AS (PARTITION BY split))
    WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY split"""


def _over_photos(select: str) -> str:
    return f"WITH {_PHOTOS} {select}"


def oracle_sql() -> dict[str, str]:
    keywords = ", ".join(f"{_count('low', p)} AS {n}" for n, p in T.KEYWORDS.items())
    features = ("desc_len", "desc_words", "kw_cat")
    profile = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS min, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.999), 6) AS q999, CAST(max(v) AS DOUBLE) AS max FROM (SELECT CAST({c} AS DOUBLE) AS v FROM feat)" for c in features)
    spear = {"desc_len": "desc_len", "desc_words": "desc_words", "age_months": "age_months", "pet_count": "pet_count", "kw_cat": "kw_cat", "n_sentences": "n_sentences"}
    ranks = " UNION ALL ".join(f"SELECT '{n}' AS feature, corr(rv, ry) AS rho FROM (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT coalesce(CAST({c} AS DOUBLE), -1) AS v, AdoptionSpeed AS y FROM feat WHERE AdoptionSpeed IS NOT NULL))" for n, c in spear.items())
    feat = f"""feat AS (SELECT b.PetID, b.split, b.AdoptionSpeed, length({_TEXT}) AS desc_len, {_count(f"regexp_replace({_TEXT}, '{_S}', ' ', 'g')", chr(92) + "S+")} AS desc_words,
        {_count(_TEXT, "!")} AS desc_excl, {_count(_TEXT, chr(92) + "p{Nd}")} AS desc_digits, {_count(_LOW, T.KEYWORDS["kw_cat"])} AS kw_cat, {_count(_TEXT, "[.!?]+")} + 1 AS n_sentences, a.age_months, c.pet_count
        FROM both_ b LEFT JOIN ages a USING (PetID, split) LEFT JOIN counts c USING (PetID, split))"""
    parsed = f"{_BASE}{_PARSED}"
    cells = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    with_photos = f"{_BASE}, {_PHOTOS}"
    return {
        "knn_target_oof": """WITH n AS (SELECT vec_id, label, vec_id % 5 AS fold, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
            u AS (SELECT vec_id, label, fold, v, sqrt(list_dot_product(v, v)) AS l FROM n),
            s AS (SELECT q.vec_id, r.vec_id AS r, r.label AS y, round(list_dot_product(q.v, r.v) / (q.l * r.l), 9) AS sim FROM u q JOIN u r ON q.fold <> r.fold),
            k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, r) AS rn FROM s QUALIFY rn <= 5),
            c AS (SELECT *, greatest(least(sim, 1), 0) AS z FROM k)
            SELECT vec_id, round(sum(power(z, 4) * y) / (sum(power(z, 4)) + 1e-9), 6) AS knn_y, CAST(min_by(y, rn) AS DOUBLE) AS nn1_y, round(max(z), 6) AS nn1_sim, round(avg(z), 6) AS knn_mean_sim FROM c GROUP BY vec_id""",
        "listings": f"{_BASE} SELECT PetID, split, {_TEXT} AS text, AdoptionSpeed, CAST(length({_NORM}) >= 5 AS INTEGER) AS valid FROM both_",
        "padded_ids": "SELECT DISTINCT PetID, CASE WHEN length(PetID) < 9 THEN lpad(PetID, 9, '0') ELSE PetID END AS padded, length(PetID) AS width FROM test",
        "image_index": f"WITH {_PHOTO} SELECT PetID, path, img_idx, split FROM photo",
        "photo_counts": f"{_BASE}, {_PHOTO} SELECT b.PetID, b.split, count(p.path) AS n_photos FROM both_ b LEFT JOIN photo p ON p.PetID = b.PetID GROUP BY b.PetID, b.split",
        "photoless_share": f"{_BASE}, {_PHOTO} SELECT split, round(avg(CAST(NOT EXISTS (SELECT 1 FROM photo p WHERE p.PetID = b.PetID) AS INTEGER)), 9) AS share, count(*) AS n FROM both_ b GROUP BY split",
        "orphan_photos": f"{_BASE}, {_PHOTO} SELECT split, count(*) AS n_photos, count(DISTINCT PetID) AS n_pets FROM photo WHERE PetID NOT IN (SELECT PetID FROM both_) GROUP BY split",
        "text_meta": f"""{_BASE} SELECT PetID, length({_TEXT}) AS desc_len, {_count(f"regexp_replace({_TEXT}, '{_S}', ' ', 'g')", chr(92) + "S+")} AS desc_words,
            round({_count(_TEXT, chr(92) + "p{Lu}")} / greatest(length({_TEXT}), 1), 9) AS desc_upper_ratio, {_count(_TEXT, "!")} AS desc_excl, {_count(_TEXT, chr(92) + "p{Nd}")} AS desc_digits,
            CAST(regexp_replace({_TEXT}, '{_S}', '', 'g') = '' AS INTEGER) AS desc_is_empty, round({_count(_TEXT, "[^" + chr(92) + "x00-" + chr(92) + "x7F]")} / greatest(length({_TEXT}), 1), 9) AS desc_non_ascii,
            round({_count(_TEXT, "[" + chr(92) + "x{4E00}-" + chr(92) + "x{9FFF}]")} / greatest(length({_TEXT}), 1), 9) AS cjk_ratio, {_count(_TEXT, "[.!?]+")} + 1 AS n_sentences FROM both_""",
        "text_keywords": f"{_BASE}, low AS (SELECT PetID, {_LOW} AS low FROM both_), k AS (SELECT PetID, {keywords}, {_count('low', T.MALAY)} AS malay_words FROM low) SELECT *, CAST(sign(kw_dog - kw_cat) AS INTEGER) AS type_text FROM k",
        "age_and_count": f"{parsed} SELECT b.PetID, round(a.age_months, 9) AS age_months, CAST(a.age_months IS NULL AS INTEGER) AS age_missing, c.pet_count FROM both_ b LEFT JOIN ages a USING (PetID, split) LEFT JOIN counts c USING (PetID, split)",
        "normalized_texts": f"{_BASE} SELECT PetID, {_NORM} AS norm, substr({_TEXT}, 1, 300) AS head FROM both_",
        "stratified_folds": f"{_BASE} SELECT PetID, AdoptionSpeed, CAST((row_number() OVER (PARTITION BY AdoptionSpeed ORDER BY md5('42-' || PetID), PetID) - 1) % 5 AS INTEGER) AS fold FROM tr",
        "class_sample": f"{_BASE} SELECT PetID, AdoptionSpeed FROM tr WHERE AdoptionSpeed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY AdoptionSpeed ORDER BY md5('7-' || PetID), PetID) <= 10",
        "subsample_means": f"{_BASE} SELECT CAST(draw AS INTEGER) AS draw, count(*) AS n, round(avg(AdoptionSpeed), 9) AS mean_speed FROM (SELECT draw, AdoptionSpeed FROM tr, range(20) d(draw) WHERE AdoptionSpeed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5('3-' || draw || ':' || PetID)) <= 50) GROUP BY draw",
        "photo_pooling": _over_photos("""SELECT PetID, CAST(i AS INTEGER) AS pos, round(arg_min(x, (img_idx, path)), 6) AS v_first, round(avg(x), 6) AS v_mean, round(max(x), 6) AS v_max
            FROM (SELECT PetID, img_idx, path, unnest(v) AS x, unnest(range(0, 64)) AS i FROM photos WHERE v IS NOT NULL) GROUP BY PetID, i"""),
        "pet_vectors": _over_photos("""SELECT PetID, n, CAST(i AS INTEGER) AS pos, round(f, 6) AS first, round(m / sqrt(sum(m * m) OVER (PARTITION BY PetID)), 6) AS mean
            FROM (SELECT PetID, i, avg(x) AS m, count(*) AS n, arg_min(x, (img_idx, path)) AS f FROM (SELECT PetID, img_idx, path, unnest(v) AS x, unnest(range(0, 64)) AS i FROM photos WHERE v IS NOT NULL) GROUP BY PetID, i)"""),
        "first_mean_similarity": _over_photos("""SELECT PetID, round(sum(m * fi) / (sqrt(sum(m * m)) * sqrt(sum(fi * fi))), 6) AS sim
            FROM (SELECT PetID, i, avg(x) AS m, arg_min(x, (img_idx, path)) AS fi FROM (SELECT PetID, img_idx, path, unnest(v) AS x, unnest(range(1, 65)) AS i FROM photos WHERE v IS NOT NULL) GROUP BY PetID, i) GROUP BY PetID"""),
        "photo_bags": f"WITH {_PHOTOS}{_BAG} SELECT PetID, n, CAST(slot - 1 AS INTEGER) AS slot, round(list_sum(v), 6) AS total, round(list_dot_product(v, v), 6) AS squares FROM bag WHERE slot <= 12",
        "attention_pooling": f"""WITH {_PHOTOS}{_ATT}, flat AS (SELECT PetID, w, unnest(v) AS x, unnest(range(0, 64)) AS pos FROM att), head AS (SELECT PetID, max(w) FILTER (slot = 1) AS first_weight, any_value(n) AS n FROM att GROUP BY PetID)
            SELECT PetID, round(first_weight, 6) AS first_weight, CAST(pos AS INTEGER) AS pos, round(p, 6) AS p FROM head JOIN (SELECT PetID, pos, sum(w * x) AS p FROM flat GROUP BY PetID, pos UNION ALL SELECT PetID, 64, ln(1 + n) FROM head) USING (PetID)""",
        "attention_by_slot": f"WITH {_PHOTOS}{_ATT} SELECT CAST(slot - 1 AS INTEGER) AS slot, round(avg(w), 6) AS mean_weight, count(*) AS n FROM att WHERE n >= 5 GROUP BY slot",
        "zero_shot": """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
            u AS (SELECT vec_id, label, unnest(v) / sqrt(list_dot_product(v, v)) AS c, unnest(range(1, 65)) AS i FROM x),
            m AS (SELECT label, i, avg(c) AS c FROM u GROUP BY label, i),
            p AS (SELECT label, list(c / l ORDER BY i) AS m FROM (SELECT label, i, c, sqrt(sum(c * c) OVER (PARTITION BY label)) AS l FROM m) GROUP BY label),
            z AS (SELECT vec_id, 'g' || (p.label % 2) AS grp, 'l' || p.label AS label, 100 * list_dot_product(v, m) / sqrt(list_dot_product(v, v)) AS z FROM x, p),
            e AS (SELECT vec_id, grp, label, exp(z - max(z) OVER (PARTITION BY vec_id, grp)) AS e FROM z)
            SELECT vec_id, grp, label, round(e / sum(e) OVER (PARTITION BY vec_id, grp), 6) AS p FROM e""",
        "tfidf_char": _tfidf(f"SELECT PetID, {_NORM} AS t FROM tr", _CHAR, 2) + _SUMMARY,
        "tfidf_word": _tfidf(f"SELECT PetID, {_LOW} AS t FROM tr), words AS (SELECT PetID, regexp_extract_all(t, '\\b\\w\\w+\\b') AS w FROM docs", _WORDS, 3, "ORDER BY total DESC, term LIMIT 50000") + _SUMMARY,
        "duplicate_groups": _dup("0.9") + " SELECT PetID, grp, count(*) OVER (PARTITION BY grp) AS group_size FROM grouped",
        "duplicate_sweep": _dup("0.9, 0.92, 0.95, 0.98") + """, per AS (SELECT threshold, grp, count(*) AS n, stddev_samp(AdoptionSpeed) AS s FROM grouped LEFT JOIN tr USING (PetID) GROUP BY threshold, grp HAVING count(*) > 1)
            SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(n) AS BIGINT) AS n_multi, count(*) AS n_groups, max(n) AS largest, round(avg(s), 6) AS mean_std FROM per GROUP BY threshold""",
        "kappa": f"{_BASE}{_SCORED} SELECT round({_qwk('y', 'p')}, 9) AS qwk, round(sqrt(avg(power(y - score, 2))), 9) AS rmse, round(avg(CAST(y = p AS INTEGER)), 9) AS agree FROM scored",
        "rater_kappa": f"WITH r AS (SELECT DISTINCT doc_id, rater, band FROM reading_labels WHERE band IS NOT NULL) SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n, round({_qwk('a.band', 'b.band')}, 9) AS qwk FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY ALL",
        "confusion": f"{_BASE}{_SCORED}, grid AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS p FROM range(1, 5) x(a), range(1, 5) z(b)), n AS (SELECT g.y, g.p, count(s.y) AS n FROM grid g LEFT JOIN scored s ON s.y = g.y AND s.p = g.p GROUP BY g.y, g.p) SELECT y, p, n, round(n / nullif(sum(n) OVER (PARTITION BY y), 0), 9) AS share FROM n",
        "roc_auc": f"{_BASE}{_SCORED}, r AS (SELECT CAST(y >= 3 AS INTEGER) AS l, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored) SELECT round((sum(r * l) - sum(l) * (sum(l) + 1) / 2.0) / nullif(sum(l) * (count(*) - sum(l)), 0), 9) AS auc FROM r",
        "spearman": f"{parsed}, {feat} SELECT feature, round(rho, 6) AS rho FROM ({ranks})".replace("FROM both_ b LEFT JOIN ages", "FROM both_ b LEFT JOIN ages"),
        "pearson": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in cells for b in cells),
        "cut_labels": f"{_BASE}{_SCORED} SELECT CASE WHEN score < 1.5 THEN 1 WHEN score < 2.5 THEN 2 WHEN score < 3.5 THEN 3 ELSE 4 END AS label, p, count(*) AS n FROM scored GROUP BY ALL",
        "split_drift": f"{parsed}, {feat} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (split = 'train'), 6) AS train_mean, round(avg({c}) FILTER (split = 'test'), 6) AS test_mean, round(100 * (avg({c}) FILTER (split = 'test') - avg({c}) FILTER (split = 'train')) / nullif(abs(avg({c}) FILTER (split = 'train')), 0), 6) AS diff_pct FROM feat" for c in ("desc_len", "desc_words", "desc_excl", "desc_digits")),
        "speed_shares": f"{_BASE} SELECT AdoptionSpeed, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM tr GROUP BY AdoptionSpeed",
        "speed_by_age": f"{parsed} SELECT {_bin('age_months')} AS age_bin, count(*) AS n, round(avg(AdoptionSpeed), 9) AS mean_speed FROM tr JOIN (SELECT * FROM ages WHERE split = 'train') USING (PetID) WHERE AdoptionSpeed IS NOT NULL GROUP BY ALL",
        "source_by_speed": f"{_BASE} SELECT source, AdoptionSpeed, count(*) AS n FROM tr WHERE source IS NOT NULL AND AdoptionSpeed IS NOT NULL GROUP BY CUBE (source, AdoptionSpeed)",
        "feature_profile": f"{parsed}, {feat} {profile}",
        "source_means": f"{_BASE}{_SCORED} SELECT source, round(avg(n), 3) AS mean_len, round(avg(score), 6) AS mean_score, count(DISTINCT n) AS n_lengths FROM scored GROUP BY source",
        "length_histogram": f"{_BASE} SELECT CAST(least(floor(least(greatest(length({_TEXT}), 0), 1000) / 50.0), 19) AS INTEGER) AS bin, count(*) AS n FROM both_ GROUP BY ALL",
        "speed_spread": f"{_BASE}, r AS (SELECT {_NORM} AS g, AdoptionSpeed AS y FROM tr WHERE AdoptionSpeed IS NOT NULL), p AS (SELECT g, count(*) AS n, stddev_samp(y) AS s FROM r GROUP BY g) SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_multi, round(avg(s), 6) AS mean_group_std, round((SELECT stddev_pop(y) FROM r), 6) AS global_std FROM p",
        "largest_group": f"{_BASE}, r AS (SELECT PetID, split, {_NORM} AS norm FROM both_) SELECT PetID, split FROM r WHERE norm = (SELECT norm FROM r GROUP BY norm ORDER BY count(*) DESC, norm LIMIT 1)",
        "texts_in_both": f"{_BASE}, r AS (SELECT split, {_NORM} AS norm FROM both_) SELECT count(*) AS n, count(DISTINCT norm) AS n_texts FROM r WHERE split = 'test' AND norm IN (SELECT norm FROM r WHERE split = 'train')",
        "photo_pets_missing": f"{_BASE}, {_PHOTO} SELECT DISTINCT PetID, 'no listing' AS missing FROM photo WHERE PetID NOT IN (SELECT PetID FROM both_) UNION ALL SELECT DISTINCT PetID, 'no photo' FROM both_ WHERE PetID NOT IN (SELECT PetID FROM photo)",
        "submission": f"SELECT min(PetID) AS PetID, CAST(1 + length(min(PetID)) % 4 AS INTEGER) AS AdoptionSpeed FROM test WHERE PetID IS NOT NULL GROUP BY {_id('PetID')}",
        "top_photos": _over_photos("SELECT path, round(v[1], 6) AS score FROM photos WHERE v IS NOT NULL ORDER BY score DESC, path LIMIT 4"),
        "photo_joins": f"{with_photos}, per AS (SELECT PetID, count(*) AS n, avg(v[1]) AS m FROM photos GROUP BY PetID) SELECT split, count(*) AS n, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS photos, count(p.m) AS with_vector, round(avg(p.m), 6) AS mean FROM both_ b LEFT JOIN per p USING (PetID) GROUP BY split",
        "inner_chain": f"{_BASE}, {_PHOTO}, {_VEC} SELECT b.split AS listed, b.source, count(*) AS n, count(DISTINCT PetID) AS n_pets FROM both_ b JOIN photo p USING (PetID) JOIN vec USING (path) GROUP BY ALL",
        "photo_rows": "SELECT path, position FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM (SELECT DISTINCT path FROM image_index WHERE path IS NOT NULL)) JOIN (SELECT DISTINCT path FROM clip_img_emb WHERE path IS NOT NULL) USING (path)",
        "length_boxes": f"{parsed}, {feat} " + " UNION ALL ".join(_BOX.format(c=c) for c in ("desc_len", "desc_words")),
        "length_density": f"{_BASE}, h AS (SELECT split, CAST(least(floor(least(greatest(length({_TEXT}), 0), 1000) / 50.0), 19) AS INTEGER) AS bin, count(*) AS n FROM both_ GROUP BY ALL) SELECT split, bin, n, round(n / sum(n) OVER (PARTITION BY split) / 50.0, 9) AS density FROM h",
        "text_knn_target": _text_knn(),
        "tfidf_word_char": _two_blocks(),
        "encoder_features": _bundles(),
        "ridge_one": _ridge_one(),
    }
