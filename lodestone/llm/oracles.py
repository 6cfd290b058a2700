"""SQL, for DuckDB, of the queries of this folder that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _SPACED)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

DECONTAMINATION = f"""WITH i AS (SELECT item_id, {_words("text", _ALPHANUMERIC)} AS ws FROM benchmark), d AS (SELECT doc_id, {_words("text", _ALPHANUMERIC)} AS ws FROM documents),
b AS (SELECT DISTINCT item_id, m, array_to_string(ws[k:k + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS k FROM (SELECT *, least(13, len(ws)) AS m FROM i WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT m FROM b), x AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, sizes WHERE len(ws) >= m)),
h AS (SELECT doc_id, x.m, k, item_id FROM x JOIN b ON x.m = b.m AND x.g = b.g), p AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS at_word FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

SUBSTRING_DEDUP = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
x AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM d)), f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM x JOIN f USING (g) WHERE first < doc_id),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _edit(best: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
    """A (cost, audit, text) with one more edit; null where there is none."""
    text = f"{best}.t || CASE WHEN {best}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{best}.t"
    return f"CASE WHEN {best} IS NOT NULL AND {when} THEN struct_pack(c := {best}.c + {cost}, a := {best}.a || '{letter}', t := {text}) END"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _inserted(select: str, source: str) -> str:
    """What may come of states n (nothing), s, u and a by inserting turns."""
    u = _least("bu", *(_edit(b, "2", "I", "'user:'") for b in ("bn", "bs", "ba")))
    return f"SELECT {select}, bn AS qn, bs AS qs, qu, {_least('ba', _edit('qu', '2', 'I', chr(39) + 'assistant:' + chr(39)))} AS qa FROM (SELECT *, {u} AS qu FROM {source})"


def _turn_repair() -> str:
    crc = "xor(list_reduce(list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda crc, b: list_reduce(CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20"
    own, may = "role || ':' || text", "f IN (0, 3)"
    keep = lambda best, initial: _edit(best, "more", "K", own, f"{may} AND i = '{initial}'")
    rerole = lambda best, role: _edit(best, "2 + more", "R", f"'{role}:' || text", may)
    delete = lambda best: _edit(best, "3", "D")
    step = ", ".join((
        f"{delete('qn')} AS bn", f"{_least(delete('qs'), keep('qn', 's'))} AS bs",
        f"{_least(delete('qu'), *(x for b in ('qn', 'qs', 'qa') for x in (keep(b, 'u'), rerole(b, 'user'))))} AS bu",
        f"{_least(delete('qa'), keep('qu', 'a'), rerole('qu', 'assistant'))} AS ba",
    ))
    joined = "(SELECT p.*, r.role, r.text, r.i, r.f, CASE WHEN r.f = 3 THEN 1 ELSE 0 END AS more FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1)"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, {crc} AS z FROM c),
m AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE z WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE z <> 0),
o AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM m),
r AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN seen > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
e AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, struct_pack(c := CAST(0 AS BIGINT), a := '', t := '') AS bn, {none} AS bs, {none} AS bu, {none} AS ba FROM conversations
 UNION ALL SELECT conv_id, k + 1, {step} FROM ({_inserted('conv_id, k, role, text, i, f, more', joined)})),
w AS (SELECT conv_id, k, list_min([qn, qa]) AS best FROM ({_inserted('conv_id, k', 'p')}))
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
 FROM w LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id WHERE k = coalesce(n, 0)"""


TURN_REPAIR = _turn_repair()
