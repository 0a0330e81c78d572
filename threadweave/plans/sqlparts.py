"""Shared parts of the DuckDB equivalents: posts tables, edges, tokens, relatives."""

from __future__ import annotations

from threadweave.functions.text import WORD_PATTERN
from threadweave.sources.adapters import LANGS, PLACES, START, TAILS

WORDS = WORD_PATTERN.replace("'", "''")


def _choose(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({n}) % {len(values)} + 1]"


def posts(shape: str = "tree", timed: bool = True, rich: bool = True) -> str:
    last, half = "CAST(conv_id * 1000 + turn - 1 AS VARCHAR)", "CAST(conv_id * 1000 + (turn - 1) // 2 AS VARCHAR)"
    targets = {"chain": f"[{last}]", "tree": f"[{half}]", "dag": f"list_distinct([{last}, {half}])", "external": f"[{half}]"}[shape]
    first = "CASE WHEN conv_id % 2 = 0 THEN ['missing'] ELSE [] END" if shape == "external" else "[]"
    at = f"{START} + conv_id * 86400 + turn * 60 + (turn * turn * 7) % 50" if timed else "CAST(NULL AS BIGINT)"
    words = f"text || {_choose(TAILS, 'turn')}" if rich else "text"
    lang, platform = (_choose(LANGS, "conv_id * 3 + turn // 2"), _choose(PLACES, "conv_id")) if rich else ("'und'", "'Twitter'")
    return (
        f"posts AS (SELECT CAST(conv_id AS VARCHAR) AS convo_id, turn AS seq, CAST(conv_id * 1000 + turn AS VARCHAR) AS uid, {words} AS text, role AS author, {at} AS sec, "
        f"CASE WHEN turn > 0 THEN {targets} ELSE {first} END AS reply_to, {lang} AS lang, {platform} AS platform FROM conversations)"
    )


EDGES = (
    "edges AS (SELECT DISTINCT p.convo_id, p.uid AS child, q.uid AS parent FROM (SELECT convo_id, uid, unnest(reply_to) AS r FROM posts) p "
    "JOIN posts q ON q.convo_id = p.convo_id AND q.uid = p.r)"
)
ABOVE = (
    "above AS (SELECT convo_id, child AS uid, parent AS member FROM edges UNION SELECT a.convo_id, a.uid, e.parent FROM above a "
    "JOIN edges e ON e.convo_id = a.convo_id AND e.child = a.member)"
)
DEPTH = (
    "steps AS (SELECT convo_id, uid, 0 AS d FROM posts WHERE uid NOT IN (SELECT child FROM edges) UNION SELECT s.convo_id, e.child, s.d + 1 FROM steps s "
    "JOIN edges e ON e.convo_id = s.convo_id AND e.parent = s.uid), "
    "depths AS (SELECT convo_id, uid, max(d) AS depth FROM steps GROUP BY 1, 2)"
)
DEGREE = (
    "degrees AS (SELECT p.convo_id, p.uid, coalesce(i.n, 0) AS in_degree, CAST(len(p.reply_to) AS BIGINT) AS out_degree, coalesce(i.n, 0) + len(p.reply_to) AS true_degree FROM posts p "
    "LEFT JOIN (SELECT convo_id, parent, count(*) AS n FROM edges GROUP BY 1, 2) i ON i.convo_id = p.convo_id AND i.parent = p.uid)"
)
TOKENS = f"tok AS (SELECT convo_id, uid, author, lang, unnest(regexp_extract_all(text, '{WORDS}')) AS token FROM posts)"


def query(body: str, *parts: str, shape: str = "tree", timed: bool = True, rich: bool = True) -> str:
    """A WITH query over the posts of a shape."""
    recursive = "RECURSIVE " if any(p in (ABOVE, DEPTH) for p in parts) else ""
    return f"WITH {recursive}{', '.join([posts(shape, timed, rich), *parts])} {body}"
