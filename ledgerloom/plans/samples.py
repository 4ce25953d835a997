"""Workloads derived from the test tables by whole-number arithmetic, in SQL that any engine reads alike."""

#: Three-arm samples, one for each event.
SAMPLES = """
SELECT event_id AS id, ts, CAST(user_id % 3 AS BIGINT) AS tenant_id, event_type AS route_id,
       CASE WHEN event_id % 41 = 7 THEN 'CONTROL' ELSE 'PAIRED' END AS kind,
       (event_id * 7919 + user_id * 31) % 100 < 92 AS ab, (event_id * 6101 + user_id * 13) % 100 < 91 AS cb,
       CASE WHEN event_id % 83 <> 5 THEN (event_id * 104729 + user_id * 17) % 100 < 92 END AS ac,
       400 + event_id % 97 AS in_a, 280 + event_id % 89 AS in_b, 400 + event_id % 101 AS in_c,
       60 + user_id % 31 AS out_a, 58 + user_id % 37 AS out_b, 60 + user_id % 29 AS out_c,
       500 + event_id % 211 AS lat_a, 450 + event_id % 307 AS lat_b, (event_id % 13) * 90 AS lat_c,
       CASE WHEN event_id % 3 <> 0 THEN event_id % 50 <> 1 END AS ok_a, CASE WHEN event_id % 3 <> 0 THEN event_id % 45 <> 2 END AS ok_b,
       CASE WHEN event_id % 61 = 3 THEN 'timeout' END AS err_a, CAST(NULL AS VARCHAR(10)) AS err_b, '' AS err_c
FROM events
"""

#: The samples that count, with what each adds to the sums, as a CTE for the SQL of queries.
VALID_CTE = f"""
samples AS ({SAMPLES}),
v AS (
  SELECT *, CAST(ab AS INT) + CAST(cb AS INT) AS t2, CAST(ac AS INT) AS c1, CAST(ab AS INT) + CAST(cb AS INT) - 2 * CAST(ac AS INT) AS d2,
         in_a + in_c AS in_json2, out_a + out_c AS out_json2,
         CASE WHEN ok_a AND NOT ok_b THEN 1 ELSE 0 END AS b1, CASE WHEN NOT ok_a AND ok_b THEN 1 ELSE 0 END AS c0,
         CASE WHEN lat_a > 0 AND lat_b > 0 AND lat_c > 0 THEN CAST(lat_b AS DOUBLE) * 2.0::DOUBLE / CAST(lat_a + lat_c AS DOUBLE) END AS lat
  FROM samples
  WHERE kind = 'PAIRED' AND coalesce(err_a, '') = '' AND coalesce(err_b, '') = '' AND coalesce(err_c, '') = ''
    AND ab IS NOT NULL AND cb IS NOT NULL AND ac IS NOT NULL
)
"""

#: Statistics over columns n, t2, c1, d2, dd4, in_json2, in_enc, out_json2, out_enc.
STATS = """
t2 / 2.0::DOUBLE / n AS agree_treatment, c1 / n::DOUBLE AS agree_control, d2 / 2.0::DOUBLE / n AS diff,
greatest(sqrt(greatest(dd4 / 4.0::DOUBLE / n - (d2 / 2.0::DOUBLE / n) * (d2 / 2.0::DOUBLE / n), 0::DOUBLE) / n), 1 / n::DOUBLE) AS se
"""
MORE = """
diff - 2.5::DOUBLE * se AS lo, diff + 2.5::DOUBLE * se AS hi,
1 - in_enc / (in_json2 / 2.0::DOUBLE) AS input_savings, out_enc / (out_json2 / 2.0::DOUBLE) - 1 AS output_change,
1 - (in_enc + 4::DOUBLE * out_enc) / (in_json2 / 2.0::DOUBLE + 4::DOUBLE * (out_json2 / 2.0::DOUBLE)) AS measured_savings
"""
