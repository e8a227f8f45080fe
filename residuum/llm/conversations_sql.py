"""DuckDB SQL of the conversation repair: the contract row by row.

A cheapest script and its costs are one text, twelve digits and the initials,
so the smaller text is the cheaper, then least script.  Two scripts of one state
and equal costs are never prefixes of one another (the longer has more inserts),
so the least one stays least whatever follows.
"""

#: The reversed polynomial of CRC-32.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(k, '')])), "
        "lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END))")


def _crc() -> str:
    """The checksum of an ASCII text ``k``, bit by bit: a byte enters with its
    first bit, then each step shifts by one."""
    return _CRC


def _add(state: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(left({state}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}, 13) || '{letter}'"


def _step(kind: str, fault: str) -> dict[str, str]:
    """States E, S, U, A after a row; NULL where no script leads there."""
    cut = f"CASE WHEN {fault} = 3 THEN 5 ELSE 0 END"
    free = lambda v, more="true": f"CASE WHEN {fault} NOT IN (1, 2) AND {more} THEN {v} END"
    gone = {q: _add(q, "2", "D") for q in "ESUA"}
    ways = {q: [gone[q]] for q in "ESUA"}
    ways["S"].append(free(_add("E", cut, "K"), f"{kind} = 's'"))
    for before in "ESA":
        ways["U"] += [free(_add(before, f"1 + {cut}", "R")), free(_add(before, cut, "K"), f"{kind} = 'u'")]
    ways["A"] += [free(_add("U", f"1 + {cut}", "R")), free(_add("U", cut, "K"), f"{kind} = 'a'")]
    return {q: f"least({', '.join(w)})" if len(w) > 1 else w[0] for q, w in ways.items()}


_AFTER = _step("kind", "fault")
_INSERT_U = f"least(U, {', '.join(_add(q, '5', 'I') for q in 'ESA')})"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {_crc()} % 20 AS h FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, rtrim(text, {_BLANKS}) AS solid FROM damaged),
rows_ AS (
  SELECT conv_id, turn, role, text, p, left(role, 1) AS kind,
         CASE WHEN solid = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
              WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY p), 1) || left(role, 1) AS two, p > 1 AS joined
  FROM placed),
counts AS (
  SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (joined AND two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
scripts AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS p, '000000000000' AS E, CAST(NULL AS VARCHAR) AS S, '000000000005I' AS U, '000000000010II' AS A FROM counts
  UNION ALL
  SELECT conv_id, n, p, E, S, U, least(A, {_add('U', '5', 'I')}) AS A
  FROM (SELECT conv_id, n, p, E, S, {_INSERT_U} AS U, A
        FROM (SELECT r.conv_id, n, r.p, {', '.join(f'{v} AS {q}' for q, v in _AFTER.items())}
              FROM scripts s JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.p = s.p + 1))),
best AS (SELECT conv_id, least(E, A) AS b FROM scripts WHERE p = n),
letters AS (SELECT conv_id, b, unnest(string_split(substr(b, 13), '')) AS edit, unnest(range(1, length(b) - 11)) AS i FROM best WHERE length(b) > 12),
numbered AS (
  SELECT conv_id, edit, i, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS p,
         sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS o FROM letters),
kept AS (
  SELECT l.conv_id, l.i, l.edit, l.o, r.role, CASE WHEN l.edit = 'I' THEN '' ELSE r.text END AS text,
         max(CASE WHEN l.o = 1 AND l.edit = 'K' AND r.kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM numbered l LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.p = l.p AND l.edit <> 'I' WHERE l.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(left(b, 12) AS BIGINT), 0) AS cost, coalesce(substr(b, 13), '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
