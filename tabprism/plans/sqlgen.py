"""DuckDB SQL text for the oracle side (multi-column statistics as UNION ALL)."""

from __future__ import annotations

from collections.abc import Sequence


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r(expr: str, digits: int | None) -> str:
    return expr if digits is None else f"(ROUND({expr}, {digits}) + 0.0)"


def dbl(c: str) -> str:
    return f"CAST({q(c)} AS DOUBLE)"


def describe_sql(src: str, cols: Sequence[str], digits: int = 4, skew: bool = False,
                 where: str | None = None) -> str:
    parts = []
    w = f" WHERE {where}" if where else ""
    for c in cols:
        x = dbl(c)
        sel = [f"'{c}' AS column_name", f"CAST(COUNT({x}) AS BIGINT) AS count",
               f"{r(f'AVG({x})', digits)} AS mean", f"{r(f'STDDEV_SAMP({x})', digits)} AS std",
               f"{r(f'MIN({x})', digits)} AS min",
               f"{r(f'QUANTILE_CONT({x}, 0.25)', digits)} AS q1",
               f"{r(f'QUANTILE_CONT({x}, 0.5)', digits)} AS median",
               f"{r(f'QUANTILE_CONT({x}, 0.75)', digits)} AS q3",
               f"{r(f'MAX({x})', digits)} AS max"]
        if skew:
            sel.append(f"{r(f'CASE WHEN COUNT({x}) > 2 THEN SKEWNESS({x}) END', digits)} AS skew")
        parts.append(f"SELECT {', '.join(sel)} FROM ({src}) _t{w}")
    return " UNION ALL ".join(parts)


def union_cols(cols: Sequence[str], template) -> str:
    """UNION ALL of ``template(i, col)`` select statements."""
    return " UNION ALL ".join(template(i, c) for i, c in enumerate(cols))


def fences_sql(src: str, cols: Sequence[str], k: float = 1.5) -> str:
    """One row per column: column_name, q1, median, q3, lo, hi."""
    def t(i, c):
        x = dbl(c)
        return (f"SELECT '{c}' AS column_name, {i} AS column_idx, QUANTILE_CONT({x}, 0.25) AS q1, "
                f"QUANTILE_CONT({x}, 0.5) AS median, QUANTILE_CONT({x}, 0.75) AS q3 FROM ({src}) _t")
    return (f"SELECT column_name, column_idx, q1, median, q3, q1 - {k} * (q3 - q1) AS lo, "
            f"q3 + {k} * (q3 - q1) AS hi FROM ({union_cols(cols, t)}) _f")


def det_sql(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions (Laplace expansion)."""
    k = len(m)
    if k == 1:
        return m[0][0]
    if k == 2:
        return f"(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"
    terms = []
    for j in range(k):
        minor = [row[:j] + row[j + 1:] for row in m[1:]]
        sign = "+" if j % 2 == 0 else "-"
        terms.append(f"{sign} ({m[0][j]}) * {det_sql(minor)}")
    return "(" + " ".join(terms) + ")"


def cramer_sql(a: list[list[str]], b: list[str]) -> list[str]:
    """Solution of a·x = b by Cramer's rule, one SQL expression per unknown."""
    d = det_sql(a)
    out = []
    for j in range(len(b)):
        aj = [row[:j] + [b[i]] + row[j + 1:] for i, row in enumerate(a)]
        out.append(f"({det_sql(aj)} / {d})")
    return out


def prep_sql(src: str, key: str, feats: list[str], target: str, extra: str = "") -> str:
    """CTE text 'd, p, s': coerce, drop incomplete rows, number by key, 80/20 split."""
    sel = ", ".join(f"TRY_CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in [*feats, target])
    nn = " AND ".join(f"{q(c)} IS NOT NULL" for c in [*feats, target])
    return (f"d AS (SELECT {key}, {sel}{extra} FROM ({src}) _src), "
            f"d2 AS (SELECT * FROM d WHERE {nn}), "
            f"p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {key}) - 1 AS pos, COUNT(*) OVER () AS n FROM d2), "
            f"s AS (SELECT *, CASE WHEN pos < CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT) "
            f"THEN 'train' ELSE 'test' END AS split FROM p)")


def moments_sql(feats: list[str], target: str) -> str:
    """CTE 'm': train count, means, population covariances (c_i_j, cy_i, vy)."""
    k = len(feats)
    parts = ["CAST(COUNT(*) AS BIGINT) AS n_train", f"AVG({q(target)}) AS ybar",
             f"COVAR_POP({q(target)}, {q(target)}) AS vy"]
    parts += [f"AVG({q(c)}) AS mu{i}" for i, c in enumerate(feats)]
    parts += [f"COVAR_POP({q(feats[i])}, {q(feats[j])}) AS c{i}_{j}" for i in range(k) for j in range(i, k)]
    parts += [f"COVAR_POP({q(c)}, {q(target)}) AS cy{i}" for i, c in enumerate(feats)]
    return f"m AS (SELECT {', '.join(parts)} FROM s WHERE split = 'train')"


def cov_name(i: int, j: int) -> str:
    return f"c{min(i, j)}_{max(i, j)}"


def logistic_ctes(train: str, feats: list[str], label: str, name: str = "lg",
                  C: float = 1.0, iters: int = 30) -> str:
    """CTE text (needs WITH RECURSIVE): L2 logistic regression by Newton steps.

    ``{name}_s`` internal standardisation, ``{name}`` the recursive iteration on
    (it, b0..bp), ``{name}_p`` the raw-scale answer (icpt, w0..w{p-1}).  Each
    step aggregates gradient and Hessian over the train rows and solves the
    system by Gaussian elimination.
    """
    p = len(feats)
    m = p + 1
    x = [f"CAST({q(f)} AS DOUBLE)" for f in feats]
    sdev = [f"STDDEV_POP({x[j]})" for j in range(p)]
    ls = (f"{name}_s AS (SELECT " + ", ".join(
        f"AVG({x[j]}) AS mu{j}, CASE WHEN {sdev[j]} = 0 THEN 1.0 ELSE {sdev[j]} END AS sd{j}" for j in range(p))
        + f" FROM {train})")
    lz = (f"{name}_z AS (SELECT CAST({q(label)} AS DOUBLE) AS y, "
          + ", ".join(f"({x[j]} - mu{j}) / sd{j} AS z{j + 1}" for j in range(p)) + f" FROM {train}, {name}_s)")
    bs = [f"b{k}" for k in range(m)]
    zk = ["1.0"] + [f"z{k}" for k in range(1, m)]
    eta = "r.b0 + " + " + ".join(f"r.b{k} * q.z{k}" for k in range(1, m))
    inner = (f"SELECT r.it, {', '.join('r.' + b for b in bs)}, q.y, {', '.join(f'q.z{k}' for k in range(1, m))}, "
             f"1 / (1 + EXP(-({eta}))) AS p FROM {name} r, {name}_z q WHERE r.it < {iters}")
    aggs = [f"SUM((p - y) * {zk[k]}) AS g{k}" for k in range(m)]
    aggs += [f"SUM(p * (1 - p) * {zk[k]} * {zk[l]}) AS h{k}_{l}" for k in range(m) for l in range(k, m)]
    agg = f"SELECT it, {', '.join(bs)}, {', '.join(aggs)} FROM ({inner}) ii GROUP BY it, {', '.join(bs)}"
    pen = ["0.0"] + [f"1.0 / ({C!r} * sd{k - 1} * sd{k - 1})" for k in range(1, m)]
    sys_cols = [f"g{k} + {pen[k]} * b{k} AS r{k}" for k in range(m)]
    sys_cols += [f"h{min(k, l)}_{max(k, l)}" + (f" + {pen[k]}" if k == l else "") + f" AS a{k}_{l}"
                 for k in range(m) for l in range(m)]
    level = f"SELECT it, {', '.join(bs)}, {', '.join(sys_cols)} FROM ({agg}) ag, {name}_s"
    step = newton_step_sql(level, m, "b")
    rec = (f"{name}(it, {', '.join(bs)}) AS (SELECT 0, {', '.join(['CAST(0 AS DOUBLE)'] * m)} "
           f"UNION ALL {step})")
    ws = [f"b{j + 1} / sd{j}" for j in range(p)]
    raw = (f"{name}_p AS (SELECT b0 - ({' + '.join(f'({ws[j]}) * mu{j}' for j in range(p))}) AS icpt, "
           + ", ".join(f"{ws[j]} AS w{j}" for j in range(p)) + f" FROM {name}, {name}_s WHERE it = {iters})")
    return ", ".join([ls, lz, rec, raw])


def logistic_z(feats: list[str], name: str = "lg", prefix: str = "") -> str:
    """Linear score of the raw-scale fit, accumulated left to right like the Spark side."""
    return f"{name}_p.icpt + " + " + ".join(f"{name}_p.w{j} * CAST({prefix}{q(f)} AS DOUBLE)"
                                            for j, f in enumerate(feats))


def newton_step_sql(level: str, m: int, state: str) -> str:
    """Given a SELECT with columns it, {state}0.., r0.. (gradient) and a{i}_{j} (Hessian),
    solve a·x = r by Gaussian elimination and emit (it + 1, state − x)."""
    for k in range(m - 1):
        rep = [f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(k + 1, m) for j in range(k + 1, m)]
        rep += [f"r{i} - a{i}_{k} / a{k}_{k} * r{k} AS r{i}" for i in range(k + 1, m)]
        level = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({level}) e{k}"
    for i in range(m - 1, -1, -1):
        acc = " - ".join([f"r{i}"] + [f"a{i}_{j} * x{j}" for j in range(i + 1, m)])
        level = f"SELECT *, ({acc}) / a{i}_{i} AS x{i} FROM ({level}) s{i}"
    return f"SELECT it + 1, {', '.join(f'{state}{k} - x{k}' for k in range(m))} FROM ({level}) st"


def softmax_ctes(train: str, feats: list[str], class_expr: str, classes: list[str], name: str = "sx",
                 C: float = 1.0, iters: int = 30) -> str:
    """CTE text (needs WITH RECURSIVE): multinomial L2 logistic regression by Newton steps.

    Parameters t{i} follow the layout (class k, term j), j = 0 intercept, with
    the last class's intercept pinned to 0.  ``{name}_p`` holds raw-scale
    intercepts c{k} and weights w{k}_{j}.  ``class_expr`` maps a train row to
    its class id (0-based, sorted class order).
    """
    p, K = len(feats), len(classes)
    x = [f"CAST({q(f)} AS DOUBLE)" for f in feats]
    sdev = [f"STDDEV_POP({x[j]})" for j in range(p)]
    ls = (f"{name}_s AS (SELECT " + ", ".join(
        f"AVG({x[j]}) AS mu{j}, CASE WHEN {sdev[j]} = 0 THEN 1.0 ELSE {sdev[j]} END AS sd{j}" for j in range(p))
        + f" FROM {train})")
    lz = (f"{name}_z AS (SELECT {class_expr} AS yi, " + ", ".join(f"({x[j]} - mu{j}) / sd{j} AS z{j + 1}"
                                                                   for j in range(p)) + f" FROM {train}, {name}_s)")
    pos = [(k, j) for k in range(K) for j in range(p + 1) if not (k == K - 1 and j == 0)]
    n = len(pos)
    at = {kj: i for i, kj in enumerate(pos)}
    ts = [f"t{i}" for i in range(n)]
    zz = ["1.0"] + [f"z{j}" for j in range(1, p + 1)]

    def score(k, pre_t, pre_z):
        head = f"{pre_t}t{at[(k, 0)]}" if (k, 0) in at else "0.0"
        return head + " + " + " + ".join(f"{pre_t}t{at[(k, j)]} * {pre_z}z{j}" for j in range(1, p + 1))
    lvl = (f"SELECT r.it, {', '.join('r.' + t for t in ts)}, q.yi, {', '.join(f'q.z{j}' for j in range(1, p + 1))}, "
           + ", ".join(f"{score(k, 'r.', 'q.')} AS s{k}" for k in range(K))
           + f" FROM {name} r, {name}_z q WHERE r.it < {iters}")
    lvl = f"SELECT *, GREATEST({', '.join(f's{k}' for k in range(K))}) AS smx FROM ({lvl}) l1"
    lvl = f"SELECT *, {', '.join(f'EXP(s{k} - smx) AS e{k}' for k in range(K))} FROM ({lvl}) l2"
    den = " + ".join(f"e{k}" for k in range(K))
    lvl = f"SELECT *, {', '.join(f'e{k} / ({den}) AS p{k}' for k in range(K))} FROM ({lvl}) l3"
    aggs = [f"SUM((p{k} - CASE WHEN yi = {k} THEN 1.0 ELSE 0.0 END) * {zz[j]}) AS g{i}" for i, (k, j) in enumerate(pos)]
    for a_ in range(n):
        for b_ in range(a_, n):
            (k, j), (l, m_) = pos[a_], pos[b_]
            w = f"p{k} * (1 - p{k})" if k == l else f"-(p{k} * p{l})"
            aggs.append(f"SUM(({w}) * {zz[j]} * {zz[m_]}) AS h{a_}_{b_}")
    agg = f"SELECT it, {', '.join(ts)}, {', '.join(aggs)} FROM ({lvl}) l4 GROUP BY it, {', '.join(ts)}"
    pen = ["0.0" if j == 0 else f"1.0 / ({C!r} * sd{j - 1} * sd{j - 1})" for k, j in pos]
    sys_cols = [f"g{i} + {pen[i]} * t{i} AS r{i}" for i in range(n)]
    sys_cols += [f"h{min(a_, b_)}_{max(a_, b_)}" + (f" + {pen[a_]}" if a_ == b_ else "") + f" AS a{a_}_{b_}"
                 for a_ in range(n) for b_ in range(n)]
    level = f"SELECT it, {', '.join(ts)}, {', '.join(sys_cols)} FROM ({agg}) ag, {name}_s"
    rec = (f"{name}(it, {', '.join(ts)}) AS (SELECT 0, {', '.join(['CAST(0 AS DOUBLE)'] * n)} "
           f"UNION ALL {newton_step_sql(level, n, 't')})")
    outs = []
    for k in range(K):
        ws = [f"t{at[(k, j + 1)]} / sd{j}" for j in range(p)]
        head = f"t{at[(k, 0)]}" if (k, 0) in at else "0.0"
        outs.append(f"{head} - ({' + '.join(f'({ws[j]}) * mu{j}' for j in range(p))}) AS c{k}")
        outs += [f"{ws[j]} AS w{k}_{j}" for j in range(p)]
    raw = f"{name}_p AS (SELECT {', '.join(outs)} FROM {name}, {name}_s WHERE it = {iters})"
    return ", ".join([ls, lz, rec, raw])


def softmax_predict_sql(feats: list[str], classes: list[str], name: str = "sx", prefix: str = "") -> str:
    """Label with the highest raw-scale score; earlier classes win ties."""
    K = len(classes)
    sc = [f"({name}_p.c{k} + " + " + ".join(f"{name}_p.w{k}_{j} * CAST({prefix}{q(f)} AS DOUBLE)"
                                           for j, f in enumerate(feats)) + ")" for k in range(K)]
    whens = []
    for k in range(K - 1):
        conds = [f"{sc[k]} > {sc[m]}" for m in range(k)] + [f"{sc[k]} >= {sc[m]}" for m in range(k + 1, K)]
        whens.append(f"WHEN {' AND '.join(conds)} THEN '{classes[k]}'")
    return f"CASE {' '.join(whens)} ELSE '{classes[-1]}' END"
