"""SQL twins that are longer than a few lines."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_lowered("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents
), grouped AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY id, run
), hashed AS (
  SELECT run, n, {_crc32("id || ':' || run")} AS h FROM grouped
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) t(i)
), near AS (
  SELECT a.word, b.word AS v, b.n AS vn FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(v, (-vn, v)) AS v, max(vn) AS vn FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 10 * w.n THEN v END AS form, CASE WHEN vn >= 10 * w.n THEN vn END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS at, form AS following FROM formed
  UNION ALL SELECT c.word, c.following, f.form FROM chain c JOIN formed f ON f.word = c.following
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.following IS NULL
"""

_WORDS = "regexp_extract_all({}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".format(_lowered("text"))

SUFFIX_MATCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT item, w, least(len(w), 10) AS n FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), sought AS (
  SELECT DISTINCT item, n, array_to_string(w[j : j + n - 1], ' ') AS g FROM items, unnest(range(1, len(w) - n + 2)) t(j)
), windows AS (
  SELECT k, j, n, array_to_string(w[j : j + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM sought) s, unnest(range(1, len(w) - n + 2)) t(j)
), hits AS (
  SELECT k, j, n, item FROM windows JOIN sought USING (n, g)
), covered AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, j, n FROM hits), unnest(range(j, j + n)) t(p) GROUP BY k
), found AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN found USING (k)
"""


def _before(letter: str, cost: str, rest: str) -> str:
    """A way to finish as text: twelve digits of cost, then the audit; ``rest`` with an edit put before it."""
    return f"(lpad(CAST(CAST(substr({rest}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letter}' || substr({rest}, 13))"


def _inserted(nodes: list[str]) -> str:
    """Each node with none, one or two insertions; where they lead is the same as for a new role."""
    to = (2, 2, 3, 2)
    one = [_before("I", "2", nodes[to[s]]) for s in range(4)]
    return ", ".join(f"least({nodes[s]}, {one[s]}, {_before('I', '2', one[to[s]])}) AS v{s}" for s in range(4))


def _edited() -> str:
    """What a row makes of each node: deleted, kept if the grammar allows its initial, or with a new role."""
    keeps = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    to, out = (2, 2, 3, 2), []
    for s in range(4):
        kept = " ".join(f"WHEN initial = '{i}' THEN {_before('K', 'late', f'v{t}')}" for i, t in keeps[s].items())
        new = _before("R", "(2 + late)", f"v{to[s]}")
        out.append(f"least({_before('D', '3', f'v{s}')}, CASE WHEN gone THEN NULL {kept} END, CASE WHEN NOT gone THEN {new} END) AS w{s}")
    return ", ".join(out)


_SPACE = "[\\x20\\x09-\\x0D]"
CONVERSATION_REPAIR = f"""
WITH RECURSIVE original AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS own_role, coalesce(text, ' ') AS own_text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations
), hashed AS (
  SELECT *, {_crc32("named")} % 20 AS h FROM original
), damaged AS (
  SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE own_role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(own_text, '.!?', '') ELSE own_text END AS text,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, own_role, md5(own_text)) AS k
  FROM hashed, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) t(again)
), flagged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?]{_SPACE}*\\z') AS unended,
         substr(lag(role) OVER (PARTITION BY conv ORDER BY k), 1, 1) AS earlier, lag(k) OVER (PARTITION BY conv ORDER BY k) AS previous
  FROM damaged
), rows AS (
  SELECT *, blank OR again AS gone, CASE WHEN unended AND NOT blank AND NOT again THEN 1 ELSE 0 END AS late FROM flagged
), counted AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(late) AS truncated,
         count(*) FILTER (WHERE previous IS NOT NULL AND NOT ((earlier = 's' AND initial = 'u') OR (earlier = 'u' AND initial = 'a') OR (earlier = 'a' AND initial = 'u'))) AS illegal
  FROM rows GROUP BY conv
), ways AS (
  SELECT conv, n AS k, '000000000000' AS v0, '000000000004II' AS v1, '000000000002I' AS v2, '000000000000' AS v3 FROM counted
  UNION ALL
  SELECT conv, k - 1, {_inserted(["w0", "w1", "w2", "w3"])} FROM (
    SELECT y.conv, y.k, {_edited()} FROM ways y JOIN rows r ON r.conv = y.conv AND r.k = y.k
  )
), audits AS (
  SELECT conv, CAST(substr(v0, 1, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM ways WHERE k = 0
), letters AS (
  SELECT conv, p, substr(audit, CAST(p AS INTEGER), 1) AS letter FROM audits, unnest(range(1, length(audit) + 1)) t(p)
), placed AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS k FROM letters
), output AS (
  SELECT l.conv, l.p, l.letter, r.role, r.text, row_number() OVER (PARTITION BY l.conv ORDER BY l.p) AS q,
         first_value(l.letter = 'K' AND r.initial = 's') OVER (PARTITION BY l.conv ORDER BY l.p) AS led
  FROM placed l LEFT JOIN rows r ON r.conv = l.conv AND r.k = l.k AND l.letter <> 'I' WHERE l.letter <> 'D'
), repaired AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q % 2 = 1) = (NOT led) THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS text
  FROM output GROUP BY conv
), every AS (
  SELECT conv, any_value(conv_id) AS conv_id FROM original GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM every LEFT JOIN counted USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired r USING (conv)
"""
