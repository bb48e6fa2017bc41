"""The same queries in DuckDB's SQL, where SQL can express them."""

OP1 = r"""
WITH base AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM base GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s1),
s3 AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, s * 2.0::DOUBLE AS cap FROM s2),
s4 AS (SELECT *, cap / w AS ratio FROM s3),
s5 AS (SELECT *, ((sum(s) OVER ())::DOUBLE * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s4),
s6 AS (SELECT lev FROM s5 WHERE lev <= ratio ORDER BY ratio, rk LIMIT 1),
s7 AS (SELECT source, rk, s, coalesce(least(cap, (SELECT lev FROM s6) * w), cap) AS target FROM s5),
s8 AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(floor(target) / s) AS BIGINT) ELSE 0 END AS epochs FROM s7),
u AS (SELECT rk, k, sum(size) AS unit FROM base JOIN s8 ON base.source IS NOT DISTINCT FROM s8.source GROUP BY rk, k),
p AS (SELECT *, CAST(sum(unit) OVER (PARTITION BY rk ORDER BY k) - unit AS BIGINT) AS before FROM u)
SELECT doc_id, size, s AS source_size, target,
       CAST(epochs * size + (greatest(0, least(CAST(floor(target) AS BIGINT) - epochs * s - before, unit)) * size) // greatest(unit, 1) AS BIGINT) AS taken,
       before AS mix_start
FROM base JOIN s8 ON base.source IS NOT DISTINCT FROM s8.source JOIN p USING (rk, k)
"""

ORACLES = {"op1_mix": OP1}


def _op2() -> str:
    from .secrets import RULES

    kinds = " UNION ALL ".join(
        f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, "
        f"regexp_extract_all(t, '{p}', {r.group}) AS vs, {r.least} AS least FROM d"
        for i, r in enumerate(RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
i AS (SELECT rid, ord, kind, least, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS n FROM k WHERE len(ms) > 0),
e AS (SELECT rid, ord, kind, least, n, length(ms[n]) AS m, length(vs[n]) AS v,
             sum(length(gaps[n]) + length(ms[n])) OVER (PARTITION BY rid, ord ORDER BY n) AS stop FROM i),
f AS (SELECT rid, sum((ord = 0)::BIGINT) AS n0, sum((ord = 1)::BIGINT) AS n1, sum((ord = 2)::BIGINT) AS n2,
             string_agg(kind || ':' || (stop - m) || ':' || stop, ',' ORDER BY stop - m, ord) AS spans
      FROM e WHERE v >= least GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN f USING (rid)
"""


ORACLES["op2_secrets"] = _op2()


def _op8() -> str:
    from .chat import CONTROLS

    special = "|".join(["\\\\", *(c.replace("[", "\\[").replace("]", "\\]") for c in CONTROLS)])
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(t) + len(regexp_extract_all(t, '{special}')) AS inner_chars,
  length(role) + len(regexp_extract_all(role, '{special}')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, role, t), '')) AS loss_sha256,
  CAST(sum(inner_chars + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 13 ELSE 24 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


ORACLES["op8_chat"] = _op8()
