"""DuckDB SQL for the text queries that SQL can express."""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k,
         len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 6))::BIGINT AS h FROM lines),
marked AS (
  SELECT *, (h + coalesce(lag(h) OVER w, 0) * 31) % 1000003 % 2 = 0 AS mark
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
ended AS (
  SELECT *, k > 1 AND k < n - 1 AND mark AND NOT lag(mark) OVER w AS ends
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ended),
chunks AS (
  SELECT doc_id, c, min(k) AS first, max(k) AS last, list(line ORDER BY k) AS ls
  FROM numbered GROUP BY doc_id, c),
around AS (
  SELECT *, list_reverse(list_concat(coalesce(lag(ls, 2) OVER w, []), coalesce(lag(ls) OVER w, []))) AS before,
         list_concat(coalesce(lead(ls) OVER w, []), coalesce(lead(ls, 2) OVER w, [])) AS after
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
judged AS (
  SELECT *, row_number() OVER w > 1 AS later, first_value(before) OVER w AS before1, first_value(after) OVER w AS after1
  FROM around WHERE last > first AND length(regexp_replace(array_to_string(ls, ''), '\\s', '', 'g')) > 0
  WINDOW w AS (PARTITION BY ls ORDER BY doc_id, c)),
grown AS (
  SELECT doc_id,
         first - coalesce(list_min([j FOR j IN range(1, least(len(before), len(before1)) + 1)
                                    IF before[j] <> before1[j]]) - 1, least(len(before), len(before1))) AS first,
         last + coalesce(list_min([j FOR j IN range(1, least(len(after), len(after1)) + 1)
                                   IF after[j] <> after1[j]]) - 1, least(len(after), len(after1))) AS last
  FROM judged WHERE later),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS k FROM grown),
told AS (
  SELECT l.*, r.k IS NOT NULL AS gone FROM lines l LEFT JOIN removed r ON r.doc_id = l.doc_id AND r.k = l.k),
runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins FROM told)
SELECT doc_id, count(*) FILTER (WHERE begins) AS n_runs_removed, count(*) FILTER (WHERE gone) AS n_lines_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM runs GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM split),
starts AS (
  SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM split WHERE len(ws) >= 20),
windows AS (
  SELECT doc_id, s, sha256(array_to_string(ws[s + 1:s + 20], ' ')) AS h FROM starts),
judged AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS copied FROM windows),
marked AS (
  SELECT w.doc_id, w.k, w.w, coalesce(max(j.copied::INT) OVER (PARTITION BY w.doc_id ORDER BY w.k
         ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM words w LEFT JOIN judged j ON j.doc_id = w.doc_id AND j.s = w.k)
SELECT d.doc_id, count(m.k) AS n_words, count(m.k) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""

SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP}
