"""SQL of the queries that DuckDB can express, on the same tables.

op5 and op8 need the 64-bit hash that Spark and the contract use, which DuckDB
lacks: it is written out in arithmetic modulo 2^64 on 128-bit numbers.
"""

from __future__ import annotations

#: The modulus, the five primes of the hash and its seed.
M = 1 << 64
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42


def big(n: int) -> str:
    return f"{n % M}::UHUGEINT" if n != M else f"{M}::UHUGEINT"


def rotl(x: str, bits: int) -> str:
    """x turned left, modulo 2^64."""
    return f"({x} * {big(1 << bits)} % {big(M)} + {x} // {big(1 << (64 - bits))})"


def turned(acc: str, lane: str) -> str:
    """An accumulator after one lane of eight bytes."""
    return f"{rotl(f'(({acc} + {lane} * {big(P2)}) % {big(M)})', 31)} * {big(P1)} % {big(M)}"


def lane(x: str, first: int, n: int) -> str:
    """A number of n bytes, the lowest first, from hexadecimal text x[...]; first: where the lane begins, as SQL."""
    return "('0x' || " + " || ".join(f"{x}[{first} + {2 * k + 1}:{first} + {2 * k + 2}]" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


SIMHASH = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
    SELECT r, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM docs WHERE len(words) > 0
), texts AS (
    SELECT DISTINCT s, octet_length(encode(s)) AS n, hex(encode(s)) AS x FROM shingles
), lanes AS (  -- numbers of eight bytes, of four and of one, the lowest byte first
    SELECT *, list_transform(generate_series(0, n // 8 - 1), lambda k: {lane('x', '16 * k', 8)}) AS eights,
        CASE WHEN n % 8 >= 4 THEN {lane('x', '16 * (n // 8)', 4)} END AS four,
        list_transform(generate_series(n // 4 * 4, n - 1), lambda k: {lane('x', '2 * k', 1)}) AS ones
    FROM texts
), stripes AS (
    SELECT *, CASE WHEN n >= 32 THEN list_transform([{big(SEED + P1 + P2)}, {big(SEED + P2)}, {big(SEED)}, {big(SEED - P1)}], lambda v, i: list_reduce(list_prepend(v, list_transform(generate_series(0, n // 32 - 1), lambda k: eights[4 * k + i])), lambda a, l: {turned('a', 'l')})) END AS v FROM lanes
), merged AS (
    SELECT *, CASE WHEN n < 32 THEN {big(SEED + P5)} ELSE list_reduce(list_prepend(({rotl('v[1]', 1)} + {rotl('v[2]', 7)} + {rotl('v[3]', 12)} + {rotl('v[4]', 18)}) % {big(M)}, v), lambda a, l: (xor(a, {turned(big(0), 'l')}) * {big(P1)} + {big(P4)}) % {big(M)}) END AS h0 FROM stripes
), eighted AS (
    SELECT *, list_reduce(list_prepend((h0 + n::UHUGEINT) % {big(M)}, eights[n // 32 * 4 + 1:]), lambda a, l: ({rotl(f"xor(a, {turned(big(0), 'l')})",27)} * {big(P1)} + {big(P4)}) % {big(M)}) AS h1 FROM merged
), foured AS (
    SELECT s, ones, CASE WHEN four IS NULL THEN h1 ELSE ({rotl(f"xor(h1, four * {big(P1)} % {big(M)})",23)} * {big(P2)} + {big(P3)}) % {big(M)} END AS h2 FROM eighted
), oned AS (
    SELECT s, list_reduce(list_prepend(h2, ones), lambda a, l: {rotl(f"xor(a, l * {big(P5)} % {big(M)})",11)} * {big(P1)} % {big(M)}) AS h3 FROM foured
), mixed1 AS (
    SELECT s, xor(h3, h3 // {big(1 << 33)}) * {big(P2)} % {big(M)} AS h FROM oned
), mixed2 AS (
    SELECT s, xor(h, h // {big(1 << 29)}) * {big(P3)} % {big(M)} AS h FROM mixed1
), hashes AS (
    SELECT s, xor(h, h // {big(1 << 32)})::UBIGINT AS h FROM mixed2
), bits AS (
    SELECT r, b, 2 * sum((h >> b::UBIGINT) & 1) > count(*) AS one FROM shingles JOIN hashes USING (s), generate_series(0, 63) g(b) GROUP BY r, b
), prints AS (
    SELECT d.r, coalesce(d.doc_id, 9223372036854775807) AS did, coalesce(sum(CASE WHEN one THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END), 0)::UBIGINT AS fp FROM docs d LEFT JOIN bits USING (r) GROUP BY d.r, d.doc_id
), nodes AS (
    SELECT fp, min(did) AS did FROM prints GROUP BY fp
), links AS MATERIALIZED (
    SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3
), reach AS (
    SELECT fp AS a, fp AS b FROM nodes
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT r.a AS fp, min(n.did) AS component FROM reach r JOIN nodes n ON r.b = n.fp GROUP BY r.a
)
SELECT nullif(p.did, 9223372036854775807)::BIGINT AS doc_id, lower(lpad(hex(p.fp), 16, '0')) AS fingerprint, nullif(l.component, 9223372036854775807)::BIGINT AS component_id FROM prints p JOIN least l USING (fp)
"""

MIXING = rf"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id, 9223372036854775807)::UBIGINT AS x FROM documents
), m AS (  -- the 64-bit hash of the id, step by step, modulo 2^64
    SELECT *, {big(M)} AS m, {big(P1)} AS p1, {big(P2)} AS p2, {big(P3)} AS p3, {big(P4)} AS p4, {big(P5)} AS p5 FROM docs
), k1 AS (
    SELECT *, (x::UHUGEINT * p2) % m AS k FROM m
), k2 AS (
    SELECT *, ((k * 2147483648 % m + k // 8589934592) * p1) % m AS j FROM k1
), k3 AS (
    SELECT *, xor(({SEED} + p5 + 8) % m, j) AS h FROM k2
), k4 AS (
    SELECT *, ((h * 134217728 % m + h // 137438953472) * p1 + p4) % m AS g FROM k3
), k5 AS (
    SELECT *, (xor(g, g // 8589934592) * p2) % m AS f FROM k4
), k6 AS (
    SELECT *, (xor(f, f // 536870912) * p3) % m AS e FROM k5
), hashed AS (
    SELECT doc_id, source, size, (xor(e, e // 4294967296) % 9223372036854775808)::BIGINT AS h FROM k6
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM hashed GROUP BY source
), ratios AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS w_all FROM sizes
), levels AS (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (w_all - coalesce(sum(w) OVER before, 0)) AS level FROM ratios
    WINDOW before AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
    SELECT source, source_size, least(cap, coalesce(max(level) FILTER (WHERE level <= ratio) OVER () * w, cap)) AS target FROM levels
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM goals
), groups AS (
    SELECT source, h, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hashed GROUP BY source, h
), taken AS (
    SELECT g.source, g.h, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, g.words, g.upto FROM groups g JOIN parts p ON g.source IS NOT DISTINCT FROM p.source
), chosen AS (
    SELECT source, h, source_size, target, whole + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - words <= rest AND 2 * (rest - (upto - words)) >= words THEN 1 ELSE 0 END AS copies FROM taken
)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * c.copies)::BIGINT AS taken FROM hashed d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

OVERLAPS = r"""
WITH dw AS (
    SELECT r, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p
    FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), iw AS (
    SELECT item_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS q
    FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL)
), diagonals AS (  -- equal words of a document and an item at one distance, in order
    SELECT r, doc_id, item_id, any_value(n) AS n, p - q AS diagonal, list(p ORDER BY p) AS places FROM dw JOIN iw USING (w) GROUP BY r, doc_id, item_id, p - q
    HAVING count(*) >= 0.8 * least(12, any_value(n)) - 1e-9
), stretches AS (
    SELECT r, doc_id, item_id, n, diagonal, places[a] AS first, places[b] - places[a] + 1 AS words, b - a + 1 AS equal
    FROM (SELECT *, unnest(generate_series(1, len(places))) AS a FROM diagonals), LATERAL (SELECT unnest(generate_series(a, len(places))) AS b)
    WHERE b - a + 1 >= 0.8 * (places[b] - places[a] + 1) - 1e-9
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY words DESC, diagonal, first) AS k FROM stretches WHERE words >= least(12, n)
), best AS (
    SELECT * FROM ranked WHERE k = 1
)
SELECT any_value(doc_id) AS doc_id, list(item_id ORDER BY item_id) AS item_ids, count(*)::BIGINT AS n_items, max(words)::BIGINT AS overlap_words, max({'w': words, 'e': equal}).e / max(words)::DOUBLE AS similarity FROM best GROUP BY r
"""

VECTORS = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), sums AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(s.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c ON v.vec_id = c.a LEFT JOIN sums s ON v.vec_id = s.a
"""

REPEATS = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
    SELECT r, unnest(generate_series(1, n - 399)) AS i FROM docs WHERE n >= 400
), windows AS (
    SELECT s.r, s.i, md5_number(t[s.i:s.i + 399]) AS h FROM starts s JOIN docs d ON s.r = d.r
), twice AS (
    SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), hits AS (
    SELECT w.r, w.i, w.i - row_number() OVER (PARTITION BY w.r ORDER BY w.i) AS island FROM windows w JOIN twice USING (h)
), runs AS (
    SELECT r, min(i) AS a, max(i) + 400 AS b FROM hits GROUP BY r, island
), marked AS (
    SELECT r, a, b, coalesce(a > max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM runs
), numbered AS (
    SELECT r, a, b, sum(fresh::INT) OVER (PARTITION BY r ORDER BY a) AS k FROM marked
), spans AS (
    SELECT r, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY r, k
), edges AS (
    SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS b FROM spans
    UNION ALL SELECT d.r, coalesce(max(s.b), 1), any_value(d.n) + 1 FROM docs d LEFT JOIN spans s ON d.r = s.r GROUP BY d.r
), kept AS (
    SELECT e.r, sha256(unhex(string_agg(CASE WHEN e.b > e.a THEN hex(d.t[e.a:e.b - 1]) ELSE '' END, '' ORDER BY e.a))) AS kept_sha256, sum(e.b - e.a) AS left_
    FROM edges e JOIN docs d ON e.r = d.r GROUP BY e.r
), counts AS (
    SELECT r, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, (d.n - k.left_)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans, k.kept_sha256, d.n > k.left_ AS repeated
FROM docs d JOIN kept k ON d.r = k.r LEFT JOIN counts c ON d.r = c.r
"""

LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
           translate(trimmed, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(trimmed) >= 10 GROUP BY key
), marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(o.owner < k.doc_id, false) AS gone
    FROM keyed k LEFT JOIN owners o ON k.key = o.key AND length(k.trimmed) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": OVERLAPS,
    "op4_embedding_near_dedup": VECTORS,
    "op5_simhash_near_dedup": SIMHASH,
    "op8_source_mixing": MIXING,
    "op9_repeated_strings": REPEATS,
    "op10_line_dedup": LINES,
}
