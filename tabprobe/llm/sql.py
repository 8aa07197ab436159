"""DuckDB SQL for the passage, near-duplicate, manifest, lexical search and license queries."""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def passages_sql(length: int = 50, piece: int = 1_000) -> str:
    """Every string of ``length`` bytes with the smallest id that holds it; texts as hexadecimal digits, in pieces that overlap."""
    return f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
pieces AS (
  SELECT doc_id, unnest(range(0, n - {length - 1}, {piece})) AS base, n, x FROM texts WHERE n >= {length}),
cut AS (SELECT doc_id, base, substr(x, 2 * base + 1, {2 * (piece + length - 1)}) AS y, least({piece}, n - {length - 1} - base) AS c FROM pieces),
starts AS (SELECT doc_id, base, y, unnest(range(0, c)) AS j FROM cut),
strings AS (SELECT doc_id, base + j AS pos, md5_number(substr(y, 2 * j + 1, {2 * length})) AS h FROM starts),
first AS (SELECT h, min(doc_id) AS low FROM strings GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, pos FROM strings JOIN first USING (h) WHERE low < doc_id),
steps AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {length} THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM steps),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + {length} AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
parts AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN parts USING (doc_id)"""


def near_sql(percent: int = 80) -> str:
    """Two-word shingles of every document, every pair that shares one, and what each document reaches over the links."""
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
pairs_of AS (
  SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(list_zip(ws[:-2], ws[2:]), lambda x: x[1] || ' ' || x[2])) END AS s
  FROM texts),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM pairs_of),
shingles AS (SELECT doc_id, hash(s) AS h, n FROM (SELECT doc_id, unnest(s) AS s FROM pairs_of) JOIN sizes USING (doc_id)),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * c >= {percent} * (nu + nv - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM texts UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)"""


def manifest_sql(tree_levels: int = 12, top_levels: int = 6) -> str:
    """Level by level from the leaves up; each leaf is folded with its siblings level by level."""
    enc = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
    fields = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 of the decimal id: each byte, then eight shifts.
    crc = ("xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
    steps = [f"""WITH d AS (
  SELECT doc_id, source, sha256({fields} || {enc('text')}) AS leaf,
         sha256({fields} || CASE WHEN {crc} % 2 = 0 THEN {enc("replace(text, chr(10), '')")} ELSE {enc('text')} END) AS later
  FROM documents),
f0 AS (SELECT doc_id, source, leaf, later AS acc, '' AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS c
       FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST)),
l0 AS (SELECT source, i, c, leaf AS h FROM f0)"""]

    def climb(f: str, level: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"""{level}{k + 1} AS (
  SELECT source, i // 3 AS i, (c + 2) // 3 AS c, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {level}{k} WHERE c > 1
  GROUP BY source, i // 3, c)""")
            left, right = (f"coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i {op} f.i), '')" for op in "<>")
            steps.append(f"""{f}{k + 1} AS (
  SELECT f.doc_id, f.source, f.leaf, CASE WHEN f.c > 1 THEN sha256({left} || f.acc || {right}) ELSE f.acc END AS acc,
         f.p || {left} || {right} AS p, f.i // 3 AS i, (f.c + 2) // 3 AS c
  FROM {f}{k} f LEFT JOIN {level}{k} l ON f.c > 1 AND l.source IS NOT DISTINCT FROM f.source AND l.i // 3 = f.i // 3 AND l.i <> f.i
  GROUP BY f.doc_id, f.source, f.leaf, f.acc, f.p, f.i, f.c)""")

    climb("f", "l", tree_levels)
    subroots = " UNION ALL ".join(f"SELECT source, h FROM l{k} WHERE c = 1" for k in range(tree_levels + 1))
    steps.append(f"""s AS ({subroots}),
sr AS (SELECT source AS name, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM s),
m0 AS (SELECT 'all' AS source, i, c, h FROM sr),
g0 AS (SELECT f.doc_id, 'all' AS source, f.leaf || sr.h AS leaf, f.acc, f.p, sr.i, sr.c
       FROM f{tree_levels} f JOIN sr ON sr.name IS NOT DISTINCT FROM f.source)""")
    climb("g", "m", top_levels)
    roots = " UNION ALL ".join(f"SELECT h FROM m{k} WHERE c = 1" for k in range(top_levels + 1))
    return ", ".join(steps) + f"""
SELECT g.doc_id, substr(g.leaf, 1, 64) AS leaf, substr(g.leaf, 65) AS subroot, r.h AS root, sha256(g.p) AS proof_sha256,
       g.acc AS folded_root, g.acc = r.h AS verified
FROM g{top_levels} g, ({roots}) r"""


def ranked_sql() -> str:
    """Every document scored for every item."""
    cut = f"regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH terms AS (SELECT doc_id, unnest({cut}) AS t FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({cut}) AS t FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
impacts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))) AS impact
  FROM tf JOIN w USING (t) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (t) GROUP BY item_id, doc_id),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10"""


def license_sql() -> str:
    """Words with their places; phrases compared word by word; notices by votes of equal word runs."""
    from tabprobe.llm.license_scan import DRIFT, LEAST_SCORE, NOTICES, PHRASES, gram_rows, template_words

    def literal(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    grams = ", ".join("(" + ", ".join(literal(v) for v in (r[0], r[1], r[3], r[6], *r[7:])) + ")" for r in gram_rows(NOTICES))
    numbers = ", ".join(f"({i}, {[j for j, w in enumerate(template_words(t.text)) if w.isdigit()]}::INTEGER[])" for i, t in enumerate(NOTICES))
    phrases = ", ".join(f"('{t.label}', {len(template_words(t.text))}, '{' '.join(template_words(t.text))}')" for t in PHRASES)
    return f"""
WITH texts AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM texts),
runs AS (SELECT doc_id, p, w AS w0, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
phrases(label, length, phrase) AS (VALUES {phrases}),
base AS (
  SELECT doc_id, p, label FROM runs JOIN phrases
  ON CASE WHEN length = 2 THEN w0 || ' ' || w1 ELSE w0 || ' ' || w1 || ' ' || w2 END = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY doc_id),
grams(tpl, label, length, tpos, t0, t1, t2) AS (VALUES {grams}),
numbers(tpl, nums) AS (VALUES {numbers}),
votes AS (
  SELECT doc_id, tpl, label, length, p, tpos, p - tpos AS diag FROM runs JOIN grams ON w0 = t0 AND w1 = t1 AND w2 = t2),
steps AS (
  SELECT *, CASE WHEN diag - lag(diag) OVER o <= least({DRIFT}, (length - 1) // 2) THEN 0 ELSE 1 END AS new
  FROM votes WINDOW o AS (PARTITION BY doc_id, tpl ORDER BY diag, tpos)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diag, tpos ROWS UNBOUNDED PRECEDING) AS grp FROM steps),
spans AS (
  SELECT doc_id, tpl, label, length, grp, list_distinct(flatten(list([tpos, tpos + 1, tpos + 2]))) AS covered, max(p) + 3 - min(p) AS span
  FROM grouped GROUP BY doc_id, tpl, label, length, grp),
scored AS (
  SELECT doc_id, label, len(covered) / greatest(length, span) AS score, list_has_all(covered, nums) AS held
  FROM spans JOIN numbers USING (tpl)),
n AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) FILTER (held AND score >= {LEAST_SCORE}) AS ls FROM scored GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(n.ls, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id)"""
