"""Oracle-SQL rounding that mirrors Spark's ``bround`` exactly.

Spark rounds a double half-even on its shortest decimal representation;
DuckDB's ``round_even`` multiplies by a power of ten first, which differs
at near-ties (11.254999999999999 -> 11.25 in Spark, 11.26 in DuckDB).
``expand_rounding`` rewrites ``round_even(x, d)`` in oracle SQL into
decimal rounding of the shortest representation, and ``round_even_sig(x,
d)`` into the same capped at ``SIG`` significant digits (used for moments
whose last binary digits depend on summation order).
"""

from __future__ import annotations

SIG = 12
MAX_EXP = 22   # same cut-off as the Spark side
_BIG = "1e19"


def _rnd(x: str, d: str) -> str:
    return (f"(CASE WHEN abs({x}) < {_BIG} THEN CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE) "
            f"ELSE round_even({x}, {d}) END)")


def _rnd_sig(x: str, d: int) -> str:
    parts = [f"WHEN abs({x}) < 1e{SIG - d} THEN {_rnd(x, str(d))}"]
    for e in range(SIG - d, MAX_EXP):
        parts.append(f"WHEN abs({x}) < 1e{e + 1} THEN {_rnd(x, str(SIG - 1 - e))}")
    return f"(CASE WHEN {x} IS NULL THEN NULL " + " ".join(parts) + f" ELSE {x} END)"


def _split_args(s: str) -> list[str]:
    depth, cur, out, quote = 0, [], [], False
    for ch in s:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append("".join(cur))
                cur = []
                continue
        cur.append(ch)
    out.append("".join(cur))
    return out


def expand_rounding(sql: str) -> str:
    for name, sig in (("round_even_sig(", True), ("round_even(", False)):
        start = 0
        while True:
            i = sql.find(name, start)
            if i < 0:
                break
            if i > 0 and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
                start = i + 1
                continue
            j, depth = i + len(name), 1
            while depth:
                if sql[j] == "(":
                    depth += 1
                elif sql[j] == ")":
                    depth -= 1
                j += 1
            args = _split_args(sql[i + len(name):j - 1])
            x = expand_rounding(args[0].strip())
            d = args[1].strip()
            rep = _rnd_sig(f"({x})", int(d)) if sig else _rnd(f"({x})", d)
            sql = sql[:i] + rep + sql[j:]
            start = i + len(rep)
    return sql
