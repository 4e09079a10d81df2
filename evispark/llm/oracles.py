"""SQL for DuckDB that gives the rows of those operator queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d)),
first AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM w JOIN first USING (win) WHERE low < doc_id),
marks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id)
"""

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d)),
first AS (SELECT win, min((doc_id, s)) AS place FROM w GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, s, (doc_id, s) > place AS later FROM w JOIN first USING (win)),
seen AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 50)) AS i FROM hit) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit WHERE later),
runs AS (SELECT doc_id, min(i) - 1 AS a, max(i) AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM runs GROUP BY doc_id),
marks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN seen USING (doc_id) LEFT JOIN marks USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, {_WORDS} AS ws FROM low),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""


def mixing(weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, fills: int = 3, bits: int = 24) -> str:
    """A source's rest is what a running sum over cells of hashes allows, once at first and again for each fill."""
    shift = 52 - bits
    steps, chosen = [], "false"
    for k in range(fills + 1):
        small = f"AND size <= gap{k}" if k else ""
        source = f"p{k}" if k else "base"
        steps.append(
            f"""cells{k} AS (SELECT skey, h >> {shift} AS cell, sum(size) AS words FROM {source} WHERE NOT taken {small} GROUP BY ALL),
run{k} AS (SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY cell) AS after FROM cells{k}),
end{k} AS (SELECT skey, min(cell) AS cell, min_by(gap{k} - after + words, cell) AS left_over FROM run{k} JOIN (SELECT DISTINCT skey, gap{k} FROM {source}) USING (skey)
  WHERE after > gap{k} AND words > 0 GROUP BY skey),
p{k + 1} AS (SELECT s.* EXCLUDE (taken), coalesce(left_over, 0) AS gap{k + 1},
  taken OR (gap{k} > 0 AND (cell IS NULL OR (h >> {shift}) < cell) {small}) AS taken FROM {source} s LEFT JOIN end{k} USING (skey))"""
        )
    listed = ", ".join(f"{w}" for w in weights)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, len({_WORDS})::BIGINT AS size,
    md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), skey, coalesce(md5(text), ''))) AS key,
    row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS copy, ('0x' || substr(md5(key || ':' || copy), 1, 13))::BIGINT AS h FROM documents),
src AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
wt AS (SELECT *, ([{listed}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}]::DOUBLE AS weight, source_size * {most}::DOUBLE AS cap FROM src),
lv AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rn,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM wt
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT skey, source_size, least(cap, (SELECT min_by(level, rn) FROM lv WHERE level <= ratio) * weight) AS target FROM lv),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM tg),
base AS (SELECT d.*, source_size, target, rounds, target - rounds * source_size AS gap0, false AS taken FROM d JOIN pl USING (skey)),
{", ".join(steps)}
SELECT doc_id, size, source_size, target, (size * (rounds + taken::INT))::BIGINT AS taken, (rounds + taken::INT)::BIGINT AS copies FROM p{fills + 1}
"""


#: Lines by number, their keys, and what stays; islands of equal verdicts give the compressed bitmap.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls[i] AS line, i, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
v AS (SELECT doc_id, i, line, coalesce(first < doc_id, false) AS gone FROM l LEFT JOIN f USING (key)),
r AS (SELECT doc_id, gone, min(i) AS low, count(*) AS n FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS island FROM v) GROUP BY doc_id, gone, island),
b AS (SELECT doc_id, CASE WHEN min_by(gone, low) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY low) AS keep FROM r GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256, any_value(keep) AS keep
FROM v JOIN b USING (doc_id) GROUP BY doc_id
"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING_DEDUP.strip(),
    "op2_minhash_dedup": MINHASH_DEDUP.strip(),
    "op7_mixing": mixing().strip(),
    "op10_suffix_array_dedup": SUFFIX_DEDUP.strip(),
    "op11_line_dedup": LINE_DEDUP.strip(),
}
