"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from runweave.llm.chat import _BEGIN, MARKS

WARC = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
     m AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN m.last IS NULL OR m.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.last <> d.page_id THEN m.last END AS refers_to,
       CASE WHEN m.last IS NULL OR m.last = d.page_id THEN true END AS intact
FROM d LEFT JOIN m ON d.n >= 1000 AND d.digest = m.digest"""

_MARKED = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
_ESCAPES = r"[\\<\[\]]"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
     f AS (SELECT *, 2 * length(t) - length(regexp_replace(t, '{_ESCAPES}', '', 'g'))
                  + CASE role {_MARKED} ELSE {len("[ROLE ] ") + len(" [/ROLE]")} + 2 * length(role) - length(regexp_replace(role, '{_ESCAPES}', '', 'g')) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(size) + {len(_BEGIN)})::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS rn FROM x),
     gone AS (SELECT DISTINCT r.doc_id, r.i + k.range AS j FROM r, range(0, 20) k WHERE r.rn > 1),
     words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
     kept AS (SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.j) AS t FROM words v LEFT JOIN gone g ON g.doc_id = v.doc_id AND g.j = v.j WHERE g.j IS NULL GROUP BY v.doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id"""

QUALITY = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS raw FROM d),
     norm AS (SELECT doc_id, host, t, trim(regexp_replace(translate(lower(raw), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
     lines AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM norm WHERE line <> ''),
     counts AS (SELECT host, line, count(DISTINCT t) AS docs FROM lines GROUP BY host, line),
     hosts AS (SELECT host, count(DISTINCT t) AS docs FROM lines GROUP BY host),
     often AS (SELECT c.host, c.line FROM counts c JOIN hosts h ON c.host IS NOT DISTINCT FROM h.host WHERE c.docs > 20 AND c.docs > h.docs * 0.005),
     gone AS (SELECT l.doc_id, count(*) AS lines, sum(l.n) AS words FROM lines l JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line GROUP BY l.doc_id),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM raw WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     win AS (SELECT doc_id, array_to_string(ws[i:i + 7], ' ') AS w, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
     twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
     rep AS (SELECT doc_id, count(DISTINCT i + k.range) AS n FROM twice, range(0, 8) k GROUP BY doc_id),
     base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                     coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words
              FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id),
     v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.5 * n_words) AS depleted FROM base)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _sketch(text: str) -> str:
    ws = _WORDS.replace("text", text, 1)
    return f"(SELECT list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16)) FROM (SELECT {ws} AS w) WHERE len(w) > 0)"


def _like(a: str, b: str) -> str:
    kept_a, kept_b = (f"list_filter(list_distinct({x}), lambda x: x < '2')" for x in (a, b))
    both = f"len(list_distinct(list_concat({kept_a}, {kept_b})))"
    return f"CASE WHEN {both} = 0 THEN (CASE WHEN list_min({a}) IS NOT DISTINCT FROM list_min({b}) THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE len(list_intersect({kept_a}, {kept_b}))::DOUBLE / {both} END"


def _text(a: str) -> str:
    kept = f"list_sort(list_filter(list_distinct({a}), lambda x: x < '2'))"
    return f"CASE WHEN len({kept}) = 0 THEN coalesce('~' || list_min({a}), '') ELSE array_to_string({kept}, '') END"


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS least FROM documents WINDOW w AS (ORDER BY doc_id)),
     e AS (SELECT doc_id, t, length(t) AS n, coalesce(after, least) AS nxt FROM d),
     x AS (SELECT *, substr(t, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM e),
     h AS (SELECT doc_id, n, edited, coalesce({_sketch("t")}, []) AS a, coalesce({_sketch("edited")}, []) AS b, coalesce({_sketch("nxt")}, []) AS c FROM x)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_text("a")} AS fingerprint, {_text("b")} AS edited_fingerprint,
       {_like("a", "b")} AS near_edited, {_like("a", "c")} AS near_next,
       CASE WHEN len(list_filter(list_distinct(a), lambda x: x < '2')) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_filter(list_distinct(a), lambda x: x < '2'), list_filter(list_distinct(b), lambda x: x < '2')))::DOUBLE
            / len(list_filter(list_distinct(a), lambda x: x < '2')) END AS kept_in_edited
FROM h"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
     f AS (SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER o AS turn,
                  (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
           FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)),
     l AS (SELECT arg_min(level, turn) AS level FROM f WHERE most / weight >= level),
     g AS (SELECT source, source_size, least(most, weight * coalesce((SELECT level FROM l), 0.0))::DOUBLE AS target FROM f),
     c AS (SELECT d.*, g.source_size, g.target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id))::BIGINT AS ahead FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
     e AS (SELECT c.*, k.range AS epoch, (k.range * source_size + ahead)::DOUBLE / target AS finish FROM c, range(0, 3) k WHERE size > 0),
     r AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS run FROM e),
     t AS (SELECT doc_id, count(*) AS epochs, sum(size)::BIGINT AS taken FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(t.epochs, 0)::BIGINT AS epochs, coalesce(t.taken, 0)::BIGINT AS taken FROM c LEFT JOIN t ON t.doc_id = c.doc_id"""

BYTES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
     n AS (SELECT doc_id, x, octet_length(x) AS n FROM d),
     v AS (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x[i + 1:i + 100] ORDER BY doc_id, i) AS turn FROM v),
     w AS (SELECT doc_id, i, i > lag(i + 100) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM r WHERE turn > 1),
     g AS (SELECT doc_id, i, sum(CASE WHEN opens IS NULL OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM w),
     spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
     gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, lead(b) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans),
     kept AS (SELECT p.doc_id, string_agg(hex(x[since + 1:a]), '' ORDER BY a) || hex(any_value(x[b + 1:]) FILTER (WHERE last)) AS hex, sum(b - a) AS removed, count(*) AS spans
              FROM gaps p JOIN n ON n.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(k.removed, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN k.hex IS NULL THEN n.x ELSE unhex(k.hex) END) AS kept_sha256
FROM n LEFT JOIN kept k ON k.doc_id = n.doc_id"""
