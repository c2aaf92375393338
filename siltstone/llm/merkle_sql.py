"""The manifest in DuckDB's SQL, for trees of up to 8**DEPTH leaves."""

from __future__ import annotations

DEPTH = 7
TOP = 4

_FIELDS = "coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen({text}) || ':' || {text}, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT))"


def _levels(name: str, keys: str, depth: int) -> list[str]:
    """Nodes of each level; a tree's only node goes on as it is."""
    out = []
    for k in range(depth):
        out.append(f"{name}{k + 1} AS (SELECT {keys}, i // 8 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(n) + 7) // 8 AS n FROM {name}{k} GROUP BY {keys}, i // 8)")
        out.append(f"{name}_runs{k} AS (SELECT {keys}, i // 8 AS b, list(h ORDER BY i) AS hs, max(n) AS n FROM {name}{k} GROUP BY {keys}, i // 8)")
    return out


def _climb(source: str, name: str, match: str, depth: int) -> list[str]:
    """From (i, proof, x) of a level to the next: siblings appended, x folded."""
    out, last = [], source
    for k in range(depth):
        here = f"{source}_{k}"
        out.append(
            f"{here} AS (SELECT t.* EXCLUDE (i, proof, x), t.i // 8 AS i, CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(hs[: t.i % 8], '') || array_to_string(hs[t.i % 8 + 2 :], '') END AS proof, "
            f"CASE WHEN r.n = 1 THEN x ELSE sha256(array_to_string(hs[: t.i % 8], '') || x || array_to_string(hs[t.i % 8 + 2 :], '')) END AS x FROM {last} t JOIN {name}_runs{k} r ON r.b = t.i // 8{match})"
        )
        last = here
    return out


def manifest() -> str:
    parts = [
        f"rows_ AS (SELECT doc_id, lang, sha256({_FIELDS.format(text='text')}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_FIELDS.format(text=_LOWER)}) END AS claimed FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows_)",
        "t0 AS (SELECT lang, i, leaf AS h, n FROM placed)",
        *_levels("t", "lang", DEPTH),
        f"s0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM t{DEPTH})",
        *_levels("s", "one", TOP),
        "low AS (SELECT doc_id, lang, leaf, i, '' AS proof, coalesce(claimed, leaf) AS x FROM placed)",
        *_climb("low", "t", " AND r.lang IS NOT DISTINCT FROM t.lang", DEPTH),
        f"high AS (SELECT p.doc_id, p.leaf, p.proof, p.x, s.h AS subroot, s.i FROM low_{DEPTH - 1} p JOIN s0 s ON s.lang IS NOT DISTINCT FROM p.lang)",
        *_climb("high", "s", "", TOP),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, s.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = s.h AS verified FROM high_{TOP - 1} p, s{TOP} s"
