"""SQL of what decompositions must find: eigenpairs by repeated squaring, and alternating steps on top of them.

Each function gives a list of common table expressions, to stand under one WITH RECURSIVE. They go
another way than the library: no eigensolver, no QR, a row for each cell.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Squarings of a matrix: its greatest eigenvalue outgrows one smaller by a share of e by exp(e * 2^SQUARINGS).
SQUARINGS = 16


def eigenpairs(matrix: str, r: int) -> list[str]:
    """`{matrix}_e` (k, p, u, l): the r greatest eigenvalues l of the positive matrix (p, q, g) and their vectors.

    A high power of a matrix has its first eigenvector in each column; then that direction is taken off.
    """
    out, g = [], matrix
    for k in range(r):
        t = f"{matrix}_{k}"
        out += [
            f"{t}s(step, p, q, g) AS (SELECT 0, p, q, g / (SELECT max(abs(g)) FROM {g}) FROM {g} UNION ALL SELECT step + 1, p, q, g / max(abs(g)) OVER () FROM (SELECT a.step, a.p, b.q, sum(a.g * b.g) AS g FROM {t}s a JOIN {t}s b ON a.q = b.p WHERE a.step < {SQUARINGS} GROUP BY ALL))",
            f"{t}c AS MATERIALIZED (SELECT p, g / sqrt(sum(g * g) OVER ()) AS u FROM {t}s WHERE step = {SQUARINGS} AND q = (SELECT q FROM {t}s WHERE step = {SQUARINGS} AND p = q ORDER BY g DESC, q LIMIT 1))",
            f"{t}l AS MATERIALIZED (SELECT sum(a.u * g * b.u) AS l FROM {g} m JOIN {t}c a ON a.p = m.p JOIN {t}c b ON b.p = m.q)",
            f"{t}d AS MATERIALIZED (SELECT m.p, m.q, g - l * a.u * b.u AS g FROM {g} m JOIN {t}c a ON a.p = m.p JOIN {t}c b ON b.p = m.q CROSS JOIN {t}l)",
        ]
        g = f"{t}d"
    return [*out, f"{matrix}_e AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {k} AS k, p, u, l FROM {matrix}_{k}c CROSS JOIN {matrix}_{k}l' for k in range(r))})"]


def started(x: str, starts: Sequence[tuple[int, int, int]], ranks: Sequence[int]) -> list[str]:
    """`f{mode}_start` (x, r, u): cells (a x + b r) mod m on the indices that the table x has."""
    return [f"f{m}_start AS MATERIALIZED (SELECT x, r, CAST(({a} * x + {b} * r) % {n} AS DOUBLE) AS u FROM (SELECT DISTINCT i{m} AS x FROM {x}) CROSS JOIN (SELECT unnest(range(0, {r})) AS r))" for m, ((a, b, n), r) in enumerate(zip(starts, ranks, strict=True))]


def hooi_fits(x: str, starts: Sequence[tuple[int, int, int]], ranks: Sequence[int], sweeps: int, order: Sequence[int]) -> str:
    """The fits (sweep, fit) of orthogonal iteration on x (i0, i1, i2, v) from those starts, rounded to 8 digits."""
    parts, at, found = started(x, starts, ranks), {m: f"f{m}_start" for m in range(3)}, []
    for sweep in range(sweeps):
        for m in order:
            a, b = (o for o in range(3) if o != m)
            t = f"w{sweep}_{m}"
            parts += [
                f"{t}y AS MATERIALIZED (SELECT i{m} AS x, a.r * {ranks[b]} + b.r AS c, sum(v * a.u * b.u) AS v FROM {x} JOIN {at[a]} a ON a.x = i{a} JOIN {at[b]} b ON b.x = i{b} GROUP BY 1, 2)",
                f"{t} AS MATERIALIZED (SELECT a.c AS p, b.c AS q, sum(a.v * b.v) AS g FROM {t}y a JOIN {t}y b USING (x) GROUP BY 1, 2)",
                *eigenpairs(t, ranks[m]),
                f"{t}f AS MATERIALIZED (SELECT x, k AS r, sum(v * u) / sqrt(any_value(l)) AS u FROM {t}y JOIN {t}_e ON p = c GROUP BY 1, 2)",
            ]
            at[m] = f"{t}f"
        found.append(f"SELECT {sweep} AS sweep, round(1 - sqrt(greatest(0, n - s)) / sqrt(n), 8) AS fit FROM (SELECT sum(v * v) AS n FROM {x}) CROSS JOIN (SELECT sum(l) AS s FROM (SELECT DISTINCT k, l FROM w{sweep}_{order[-1]}_e))")
    return f"{', '.join(parts)} {' UNION ALL '.join(found)}"


def als_fits(x: str, starts: Sequence[tuple[int, int, int]], core: str, sweeps: int, penalty: float) -> str:
    """The fits (sweep, fit) of ridge regression by rows at rank 2; core is an expression of r0, r1, r2.

    The two unknowns of a row are solved by Cramer's rule.
    """
    parts, at, found = started(x, starts, (2, 2, 2)), {m: f"f{m}_start" for m in range(3)}, []
    ranges = " CROSS JOIN ".join(f"(SELECT unnest(range(0, 2)) AS r{m})" for m in range(3))
    parts.append(f"core AS MATERIALIZED (SELECT r0, r1, r2, CAST({core} AS DOUBLE) AS g FROM {ranges})")
    for sweep in range(sweeps):
        for m in range(3):
            a, b = (o for o in range(3) if o != m)
            t = f"w{sweep}_{m}"
            d = ", ".join(f"sum(g * a.u * b.u) FILTER (r{m} = {r}) AS d{r}" for r in range(2))
            parts += [
                f"{t}d AS MATERIALIZED (SELECT i0, i1, i2, any_value(v) AS v, {d} FROM {x} JOIN {at[a]} a ON a.x = i{a} JOIN {at[b]} b ON b.x = i{b} JOIN core ON core.r{a} = a.r AND core.r{b} = b.r GROUP BY 1, 2, 3)",
                f"{t}n AS MATERIALIZED (SELECT i{m} AS x, sum(d0 * d0) + {penalty} AS b00, sum(d0 * d1) AS b01, sum(d1 * d1) + {penalty} AS b11, sum(v * d0) AS c0, sum(v * d1) AS c1 FROM {t}d GROUP BY 1)",
                f"{t}f AS MATERIALIZED (SELECT x, 0 AS r, (c0 * b11 - c1 * b01) / (b00 * b11 - b01 * b01) AS u FROM {t}n UNION ALL SELECT x, 1, (c1 * b00 - c0 * b01) / (b00 * b11 - b01 * b01) FROM {t}n)",
            ]
            at[m] = f"{t}f"
        # The last mode's own sums d, met with its new rows, are the model's values.
        found.append(f"SELECT {sweep} AS sweep, round(1 - sqrt(sum((v - w) * (v - w)) / sum(v * v)), 6) AS fit FROM (SELECT v, d0 * p.u + d1 * q.u AS w FROM w{sweep}_2d JOIN (SELECT * FROM {at[2]} WHERE r = 0) p ON p.x = i2 JOIN (SELECT * FROM {at[2]} WHERE r = 1) q ON q.x = i2)")
    return f"{', '.join(parts)} {' UNION ALL '.join(found)}"
