"""SQL check of the conversation repair: a recursive query from each conversation's last row to its first."""

#: States: nothing written, system's turn, user's turn, assistant's turn; state -> [(initial, next state)].
_STEPS = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
_NAMES = {"u": "user", "a": "assistant"}


def _edit(letter: str, cost: str, rest: str, written: str | None) -> str:
    lines = f"list_prepend({written}, {rest}.r)" if written else f"{rest}.r"
    return f"CASE WHEN {rest} IS NOT NULL THEN {{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'r': {lines}}} END"


def _after_row(q: int) -> str:
    options = [_edit("D", "2", f"b{q}", None)]
    for initial, p in _STEPS[q]:
        options.append(f"CASE WHEN x <> 'x' AND i = '{initial}' THEN {_edit('K', 'e', f'b{p}', "role || ':' || text")} END")
        if initial in _NAMES:
            options.append(f"CASE WHEN x <> 'x' THEN {_edit('R', '1 + e', f'b{p}', f"'{_NAMES[initial]}:' || text")} END")
    return f"list_min([{', '.join(options)}]) AS b{q}"


def _insertion(q: int) -> str:
    options = [f"b{q}", *(_edit("I", "5", f"b{p}", f"'{_NAMES[i]}:'") for i, p in _STEPS[q] if i in _NAMES)]
    return f"list_min([{', '.join(options)}]) AS b{q}"


def _all(of) -> str:
    return ", ".join(of(q) for q in range(4))


_EMPTY = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"


def crc32_table() -> str:
    """DuckDB has no crc32, so its table is written out from the polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"[{', '.join(map(str, out))}]::UBIGINT[]"


CHECK = f"""
WITH RECURSIVE source AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce([CAST(ascii(key[k]) AS UBIGINT) FOR k IN range(1, length(key) + 1)],
    lambda h, c: xor(h >> 8, crcs[1 + CAST(xor(h, c) % 256 AS BIGINT)]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS kind
  FROM source, (SELECT {crc32_table()} AS crcs)
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS place,
    regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS letters
  FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY place) || left(role, 1) AS pair,
    CASE WHEN letters = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(letters, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '-' END AS fault
  FROM placed
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM judged GROUP BY conv
), solved(conv, spot, b0, b1, b2, b3) AS (
  SELECT conv, n, {_all(_insertion)} FROM (
    SELECT conv, n, {_all(_insertion)} FROM (SELECT conv, n, {_EMPTY} AS b0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS b1,
      NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS b2, {_EMPTY} AS b3 FROM counted))
  UNION ALL
  SELECT conv, spot, {_all(_insertion)} FROM (
    SELECT conv, spot, {_all(_insertion)} FROM (
      SELECT conv, place - 1 AS spot, {_all(_after_row)} FROM (
        SELECT s.*, j.place, j.role, j.text, j.i, CASE WHEN j.fault IN ('blank', 'duplicate') THEN 'x' ELSE '-' END AS x,
          CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END AS e
        FROM solved s JOIN judged j ON j.conv IS NOT DISTINCT FROM s.conv AND j.place = s.spot)))
)
SELECT s.conv AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0.c, 0) AS cost, coalesce(b0.a, '') AS audit,
  sha256(coalesce(array_to_string(b0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM source) s LEFT JOIN counted c ON c.conv IS NOT DISTINCT FROM s.conv
LEFT JOIN solved d ON d.conv IS NOT DISTINCT FROM s.conv AND d.spot = 0
"""
