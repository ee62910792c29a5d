"""DuckDB SQL that finds the optimum of a penalised likelihood by itself.

Newton's method as a recursive query: the objective is evaluated at the current point and at its
neighbours in the logarithms of the parameters, gradient and Hessian are central differences, and
a step solves the system by pivots made positive. Nothing is shared with the fits but the formula
of the likelihood, written here with ``lgamma`` as in the papers.
"""

from __future__ import annotations

from itertools import combinations

from retenta.config import PENALIZER
from retenta.plans.registered_models import BGNBD_DIGITS, GAMMA_GAMMA_DIGITS

STEP = 1e-4
ROUNDS = 60
#: Smaller pivots count as this much; at a border of the parameters there are such.
LEAST_PIVOT = 1e-6


def _offsets(size: int) -> dict[str, dict[int, int]]:
    """Names and offsets of the points around the current one."""
    points: dict[str, dict[int, int]] = {"f": {}}
    for i in range(size):
        points |= {f"f{i}p": {i: 1}, f"f{i}m": {i: -1}}
    for i, j in combinations(range(size), 2):
        points |= {f"f{i}{j}{a}{b}": {i: x, j: y} for a, x in (("p", 1), ("m", -1)) for b, y in (("p", 1), ("m", -1))}
    return points


def optimum(rows: str, names: tuple[str, ...], likelihood: str, scale_back: dict[str, str], digits: dict[str, int]) -> str:
    """Columns: the parameters, ``objective``, ``gradient_norm``, ``least_pivot``, ``n_customers``.

    ``rows`` selects the data with a weight ``n``; ``likelihood`` is a row's log-likelihood in ``names``.
    """
    size, points = len(names), _offsets(len(names))
    thetas = [f"t{k}" for k in range(size)]
    values = ", ".join(
        "(" + ", ".join([f"'{name}'", *(f"{STEP * at.get(k, 0)!r}::DOUBLE" for k in range(size))]) + ")" for name, at in points.items()
    )
    at_point = ", ".join(f"exp(s.t{k} + p.d{k}) AS {name}" for k, name in enumerate(names))
    penalty = " + ".join(f"{name} * {name}" for name in names)
    picked = ", ".join(f"MAX(f) FILTER (pid = '{name}') AS {name}" for name in points)
    slopes = [f"(f{i}p - f{i}m) / {2 * STEP!r} AS g{i}" for i in range(size)]
    bends = [f"(f{i}p - 2 * f + f{i}m) / {STEP**2!r} AS h{i}{i}" for i in range(size)]
    bends += [f"(f{i}{j}pp - f{i}{j}pm - f{i}{j}mp + f{i}{j}mm) / {4 * STEP**2!r} AS h{i}{j}" for i, j in combinations(range(size), 2)]
    # Pivots of the Hessian, top left to bottom right, and the step that solves for the gradient.
    solve = []
    for j in range(size):
        solve.append(f"h{j}{j}" + "".join(f" - l{j}{k} * l{j}{k} * e{k}" for k in range(j)) + f" AS d{j}")
        solve.append(f"greatest(abs(d{j}), {LEAST_PIVOT}) AS e{j}")
        for i in range(j + 1, size):
            solve.append(f"(h{j}{i}" + "".join(f" - l{i}{k} * l{j}{k} * e{k}" for k in range(j)) + f") / e{j} AS l{i}{j}")
    for i in range(size):
        solve.append(f"g{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f" AS y{i}")
    for i in reversed(range(size)):
        solve.append(f"y{i} / e{i}" + "".join(f" - l{k}{i} * s{k}" for k in range(i + 1, size)) + f" AS s{i}")
    longest = "greatest(" + ", ".join(f"abs(s{k})" for k in range(size)) + ", 1.0)"
    moved = ", ".join(f"t{k} - s{k} / {longest} AS t{k}" for k in range(size))
    listed = ", ".join(thetas)
    around = f"""
        SELECT i, {listed}, {picked} FROM (
            SELECT i, {listed}, pid, -SUM(n * ({likelihood})) / SUM(n) + {PENALIZER} * MAX({penalty}) AS f
            FROM (SELECT s.i, {", ".join(f"s.t{k}" for k in range(size))}, p.pid, {at_point} FROM search s, points p) AS a, data
            GROUP BY i, {listed}, pid) GROUP BY i, {listed}"""
    derived = f"SELECT *, {', '.join(slopes + bends)} FROM ({around})"
    solved = f"SELECT *, {', '.join(solve)} FROM ({derived})"
    norm = "greatest(" + ", ".join(f"abs(g{k})" for k in range(size)) + ")"
    pivots = "least(" + ", ".join(f"d{k}" for k in range(size)) + ")"
    own = ", ".join(
        f"round({scale_back.get(name, '')}exp(t{k}), {digits[name]}) AS {name}" for k, name in enumerate(names)
    )
    # The last point's own values: what is found around it before the next step.
    return f"""
        SELECT {own}, round(f, {digits['objective']}) AS objective, round({norm}, 4) + 0.0 AS gradient_norm,
               round({pivots}, {digits['least_pivot']}) + 0.0 AS least_pivot,
               (SELECT CAST(SUM(n) AS BIGINT) FROM data_rows) AS n_customers
        FROM (
            WITH RECURSIVE data AS MATERIALIZED (SELECT * FROM data_rows),
            points(pid, {', '.join(f'd{k}' for k in range(size))}) AS (VALUES {values}),
            search AS (
                SELECT 0 AS i, {', '.join(f'0.0::DOUBLE AS t{k}' for k in range(size))}
                UNION ALL
                SELECT i + 1 AS i, {moved} FROM ({solved.replace('FROM search s', 'FROM (SELECT * FROM search WHERE i < ' + str(ROUNDS) + ') AS s')}))
            {solved.replace('FROM search s', f'FROM (SELECT * FROM search WHERE i = {ROUNDS}) AS s')})""".replace("data_rows", f"({rows})")


BGNBD_ROWS = """
    SELECT x, last / MAX(age) OVER () AS last, age / MAX(age) OVER () AS age, n FROM (
        SELECT CAST(x AS DOUBLE) AS x, last, age, CAST(COUNT(*) AS DOUBLE) AS n FROM inputs GROUP BY x, last, age)"""
BGNBD_LIKELIHOOD = """
    lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    - (r + x) * ln(alpha + age)
    + ln(1 + CASE WHEN x > 0 THEN exp(ln(a) - ln(b + greatest(x, 1) - 1) + (r + x) * (ln(alpha + age) - ln(alpha + last))) ELSE 0 END)"""
GAMMA_GAMMA_ROWS = """
    SELECT CAST(x AS DOUBLE) AS x, monetary_value AS m, CAST(1 AS DOUBLE) AS n FROM inputs WHERE x >= 1"""
GAMMA_GAMMA_LIKELIHOOD = """
    lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1) * ln(m) + p * x * ln(x) - (p * x + q) * ln(x * m + v)"""


def statements() -> dict[str, str]:
    longest = "(SELECT MAX(age) FROM inputs ) * "
    bgnbd = optimum(BGNBD_ROWS, ("r", "alpha", "a", "b"), BGNBD_LIKELIHOOD, {"alpha": longest}, BGNBD_DIGITS)
    gamma_gamma = optimum(GAMMA_GAMMA_ROWS, ("p", "q", "v"), GAMMA_GAMMA_LIKELIHOOD, {}, GAMMA_GAMMA_DIGITS)
    return {
        "bgnbd_fit": bgnbd,
        "gamma_gamma_fit": gamma_gamma,
        "clv_params_roundtrip": f"SELECT r, alpha, a, b, p, q, v FROM ({bgnbd}) AS one, ({gamma_gamma}) AS two",
    }
