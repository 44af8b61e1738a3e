"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP10 = f"""
WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g WHERE len(gram) = 5),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS o(k) WHERE times > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_case, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower_case,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR upper_case > lower_case + 20
       OR 10 * bangs > 3 * n_words OR word_chars > 40 * n_words) AS kept
FROM b
"""

NUMBER = "CAST('0x' || substr({}, 1, 15) AS BIGINT)"
OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len({WORDS}) + 1 AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS share FROM d GROUP BY source),
goal AS (SELECT 0.5 * (-sum(share * ln(share))) + 0.5 * ln(count(*)) AS entropy, sum(tokens) AS budget FROM s),
flat AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN low THEN lo ELSE mid END, CASE WHEN low THEN mid ELSE hi END
  FROM (SELECT k, lo, hi, mid, (SELECT ln(sum(pow(share, mid))) - mid * sum(pow(share, mid) * ln(share)) / sum(pow(share, mid)) FROM s) < (SELECT entropy FROM goal) AS low
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM flat WHERE hi - lo > 1e-12))),
p1 AS (SELECT CASE WHEN (SELECT -sum(share * ln(share)) FROM s) < (SELECT entropy FROM goal) THEN round((SELECT (lo + hi) / 2 FROM flat ORDER BY k DESC LIMIT 1), 9) ELSE 1 END AS power),
over AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN kept THEN lo ELSE mid END, CASE WHEN kept THEN mid ELSE hi END
  FROM (SELECT k, lo, hi, mid, (SELECT max(pow(share, mid) / tokens) / sum(pow(share, mid)) * (SELECT budget FROM goal) FROM s) <= 2 AS kept
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM over WHERE hi - lo > 1e-12))),
p AS (
  SELECT CASE WHEN (SELECT max(pow(share, power) / tokens) / sum(pow(share, power)) * (SELECT budget FROM goal) FROM s) <= 2 THEN power
              ELSE least(1, ceil((SELECT (lo + hi) / 2 FROM over ORDER BY k DESC LIMIT 1) * 1e9) / 1e9) END AS power FROM p1),
w AS (SELECT source, tokens, n, power, pow(share, power) / (SELECT sum(pow(share, power)) FROM s) AS weight FROM s, p),
q AS (
  SELECT source, power, weight, CAST(floor(weight * (SELECT budget FROM goal)) AS BIGINT) // tokens AS whole, CAST(floor(weight * (SELECT budget FROM goal)) AS BIGINT) % tokens AS rest,
    greatest(1, CAST(ceil(n / 2048.0) AS BIGINT)) AS blocks FROM w),
b AS (SELECT d.*, power, weight, whole, rest, {NUMBER.format("md5('7:' || name)")} % blocks AS block FROM d JOIN q USING (source)),
e AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('7:block:' || whole || ':' || block), block, md5('7:doc:' || whole || ':' || name), doc_id NULLS LAST, n_tokens
                                ROWS UNBOUNDED PRECEDING) AS upto FROM b),
r AS (
  SELECT *, unnest(range(whole)) AS epoch FROM b
  UNION ALL SELECT * EXCLUDE (upto), whole FROM e WHERE upto <= rest)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, round(weight, 9) AS weight, CAST(power AS DOUBLE) AS power, {NUMBER.format("md5('7:read:' || epoch || ':' || name)")} AS position FROM r
"""

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
WHOLE = "list_transform(embedding, lambda x: CAST(floor({} * CAST(x AS DOUBLE)) AS BIGINT))"
DOWN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"  # floor(s / n)
SQUARE = "CAST(list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _rounds(rounds: int, key: str, start: str, of: str) -> str:
    """c0 is the start; a{k} assigns every row of x to the nearest entry of c{k}, c{k+1} has the entries moved. of: the columns of an entry."""
    own = f"{key}, " if key else ""
    match = f" JOIN c{{k}} c USING ({key})" if key else ", c{k} c"
    out = [f"c0 AS MATERIALIZED ({start})"]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, {own}min(struct_pack(d := d, e := e)) AS best, any_value(v) AS v
  FROM (SELECT x.vec_id, {'x.part, ' if key else ''}x.v, c.e, {SQUARE.format('x.v', 'c.v')} AS d FROM x{match.format(k=k)}) GROUP BY {own}vec_id)""")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT {of}, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
    SELECT {own}e, list({DOWN} ORDER BY i) AS v FROM (
      SELECT {own}best.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(v)) FROM x)) AS r(i) GROUP BY ALL) GROUP BY {own}e) m USING ({of}))""")
    return ",\n".join(out)


OP11 = f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, {WHOLE.format(1024)} AS v, len(embedding) // 4 AS width FROM embeddings WHERE {USABLE}),
x AS MATERIALIZED (SELECT vec_id, p AS part, v[p * width + 1 : (p + 1) * width] AS v FROM w, range(4) AS r(p)),
{_rounds(4, "part", "SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < 256", "part, e")},
d AS (SELECT vec_id, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d JOIN w USING (vec_id), h
"""

OP12 = f"""
WITH x AS MATERIALIZED (SELECT vec_id, {WHOLE.format(256)} AS v FROM embeddings WHERE {USABLE} AND len(embedding) = 64),
{_rounds(5, "", "SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS e, v FROM x QUALIFY e < 40", "e")}
SELECT vec_id, CAST(best.e AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.e) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.e = best.e
"""

ORACLES: dict[str, str] = {"op3_temperature_mixing": OP3, "op6_quality_cascade": OP6, "op10_exact_dedup": OP10, "op11_slice_codes": OP11, "op12_equal_average_clusters": OP12}
