"""SQL for each registered query, written independently: exponential weights as a self-join over row distances,
rolling sums as window frames, regressions by cofactors."""

from __future__ import annotations

INDUSTRIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
KEEP = "(1e0 - 2e0/23)"

# percent per line, as whole numbers, so that sums do not depend on the order of the rows
NET = "(cast(round(l_discount*100) as bigint) - cast(round(l_tax*100) as bigint))"


def mean_net(condition: str) -> str:
    return f"(cast(sum(case when {condition} then {NET} end) as double)/count(case when {condition} then 1 end))"


ASSETS = """
base as (
  select l_suppkey as asset, cast(l_shipdate as date) as dt, cast(sum(NET) as double)/count(*) as ret,
         sum(cast(round(l_extendedprice*100) as bigint))/sum(l_quantity)/10000 as price
  from lineitem group by 1, 2),
assets as (
  select b.asset, b.dt, b.ret, b.price, b.ret - avg(b.ret) over (partition by b.dt) as specific_return,
         10e0 + abs(s_acctbal)/500 as specific_risk, 0.5e0 + (s_nationkey % 10)/10e0 as predicted_beta
  from base b join supplier on s_suppkey = b.asset)""".replace("NET", NET)

EXPOSURES = """
exposures as (
  select l_suppkey as asset, cast(l_shipdate as date) as dt, {cells}
  from lineitem join part on p_partkey = l_partkey group by 1, 2)""".format(cells=", ".join(
    f"sum(case when p_type = '{x}' and l_discount > 0 then 1e0 end) as IND_{x}" for x in INDUSTRIES))

FACTORS = """
factors as (
  select cast(l_shipdate as date) as dt, {cells}
  from lineitem join part on p_partkey = l_partkey group by 1)""".format(cells=", ".join(
    f"coalesce({mean_net(f"p_type = '{x}'")}, 0e0) as IND_{x}" for x in INDUSTRIES))

FACTORS_LONG = "factors_long as (" + " union all ".join(
    f"select dt, 'IND_{x}' as industry, IND_{x} as ret from factors" for x in INDUSTRIES) + ")"

FACTOR_MODEL = f"""
factor_model as (
  select cast(l_shipdate as date) as dt, {mean_net('true')}/100 as mktrf,
         ({mean_net('p_size <= 25')} - {mean_net('p_size > 25')})/100 as smb,
         ({mean_net('l_quantity > 25')} - {mean_net('l_quantity <= 25')})/100 as hml
  from lineitem join part on p_partkey = l_partkey group by 1)"""

_TOTAL = " + ".join(f"coalesce(IND_{x}, 0)" for x in INDUSTRIES)
EXPOSURES_LONG = "exposures_long as (" + " union all ".join(
    f"select dt, asset, 'IND_{x}' as industry, {_TOTAL} as total, coalesce(IND_{x}, 0) as flag from exposures"
    for x in INDUSTRIES) + ")"
SHARES_ZERO = """shares as (
  select dt, asset, industry, case when total = 0 then 0e0 else flag/total end as exposure
  from exposures_long where total = 0 or flag > 0)"""
SHARES_DROP = "shares as (select dt, asset, industry, flag/total as exposure from exposures_long where total <> 0 and flag > 0)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"case when round({expression}, {digits}) = 0 then 0e0 else round({expression}, {digits}) end as {name}"


def d(name: str = "dt") -> str:
    return f"strftime({name}, '%Y-%m-%d') as {name}"


def ewm(prefix: str, source: str, key: str, value: str, min_periods: int) -> str:
    """CTEs {prefix}_rows and {prefix}_vol: exponentially weighted deviation per row."""
    return f"""
{prefix}_rows as (
  select *, {value} as x, row_number() over (partition by {key} order by dt) as rn from {source}),
{prefix}_sums as (
  select a.{key}, a.rn, count(b.x) as n, sum(pow({KEEP}, a.rn - b.rn)) as w, sum(pow({KEEP}, 2*(a.rn - b.rn))) as ww,
         sum(pow({KEEP}, a.rn - b.rn) * b.x) as wx, sum(pow({KEEP}, a.rn - b.rn) * b.x * b.x) as wxx
  from {prefix}_rows a join {prefix}_rows b on a.{key} = b.{key} and b.rn <= a.rn and b.x is not null
  group by 1, 2),
{prefix}_vol as (
  select p.*, case when s.n >= {max(min_periods, 2)} and p.x is not null
                   then sqrt(greatest((s.wxx/s.w - pow(s.wx/s.w, 2)) / (1 - s.ww/(s.w*s.w)), 0)) end as vol
  from {prefix}_rows p left join {prefix}_sums s on s.{key} = p.{key} and s.rn = p.rn)"""


def momentum(prefix: str, source: str, key: str, value: str, min_periods: int) -> str:
    """CTE {prefix}: scaled_ret and lagged full-window momentum."""
    return ewm(prefix, source, key, value, min_periods) + f""",
{prefix}_scaled as (select *, x/nullif(vol, 0) as scaled_ret from {prefix}_vol),
{prefix}_total as (
  select *, case when count(scaled_ret) over f = 230 then sum(scaled_ret) over f end as total
  from {prefix}_scaled window f as (partition by {key} order by dt rows between 229 preceding and current row)),
{prefix} as (select *, lag(total, 22) over (partition by {key} order by dt) as momentum from {prefix}_total)"""


def own_signal(name: str, value: str) -> str:
    """Standard and idiosyncratic signals."""
    p = f"{name}_m"
    return ASSETS_FRACTION + ",\n" + momentum(p, "fraction", "asset", value, 22) + f""",
{name}_kept as (
  select * from (select *, lag(price) over (partition by asset order by dt) as price_lag from {p})
  where price_lag > 5 and momentum is not null),
{name}_z as (
  select *, (momentum - avg(momentum) over (partition by dt))
            / nullif(stddev_samp(momentum) over (partition by dt), 0) as z from {name}_kept),
{name} as (
  select asset, dt, ret, price_lag, z as momentum_zscore, z*0.5*specific_risk as alpha, z as signal, specific_risk,
         predicted_beta from {name}_z)"""


ASSETS_FRACTION = """fraction as (
  select asset, dt, ret/100 as ret, specific_return/100 as specific_return, price, specific_risk, predicted_beta
  from assets)"""

FACTOR_MOMENTUM = momentum("fm_all", "factors_long", "industry", "ret", 1) + """,
factor_momentum as (
  select dt, industry, vol, momentum from fm_all
  where vol is not null and scaled_ret is not null and momentum is not null)"""

SCORES = """scores as (
  select s.dt, s.asset, coalesce(sum(exposure*momentum), 0e0) as momentum_score
  from shares s left join factor_momentum m on m.dt = s.dt and m.industry = s.industry group by 1, 2)"""

INDUSTRY = """industry as (
  select * from (
    select asset, dt, ret/100 as ret, lag(price) over (partition by asset order by dt) as price_lag,
           z as momentum_zscore, z*0.5*specific_risk as alpha, z as signal, specific_risk, predicted_beta
    from (select s.asset, s.dt, a.ret, a.price, a.specific_risk, a.predicted_beta,
                 (momentum_score - avg(momentum_score) over (partition by s.dt))
                 / nullif(stddev_samp(momentum_score) over (partition by s.dt), 0) as z
          from scores s left join assets a on a.asset = s.asset and a.dt = s.dt))
  where price_lag >= 5 and alpha is not null)"""


def industry_parts(shares: str) -> list[str]:
    return [EXPOSURES, EXPOSURES_LONG, shares, FACTORS, FACTORS_LONG, FACTOR_MOMENTUM, SCORES, INDUSTRY]


STANDARD = [ASSETS, own_signal("standard", "ret")]
SIGNAL = [*STANDARD, "sig as (select * from standard where alpha is not null)"]

FORWARD = """fwd as (
  select s.dt, s.asset, alpha, f
  from sig s join (select dt, asset, lead(ret/100) over (partition by asset order by dt) as f from assets) n
    on n.dt = s.dt and n.asset = s.asset
  where f is not null)"""

QUANTILES = [*SIGNAL, FORWARD, """
ranked as (
  select *, cast(floor((rank() over (partition by dt order by alpha) - 1) * 5 / count(*) over (partition by dt)) as int) + 1
            as bucket from fwd),
wide as (
  select * from (
    select dt, """ + ", ".join(f"avg(case when bucket = {b} then f end) as p_{b}" for b in range(1, 6)) + """,
           avg(case when bucket = 5 then f end) - avg(case when bucket = 1 then f end) as spread, avg(f) as bmk_return
    from ranked group by dt)
  where """ + " and ".join(f"p_{b} is not null" for b in range(1, 6)) + "),\nports as (" + " union all ".join(
    f"select dt, '{c}' as quantile, {c} as ret from wide"
    for c in ["p_1", "p_2", "p_3", "p_4", "p_5", "spread", "bmk_return"]) + ")"]

METRICS = """metrics as (
  select quantile, avg(ret)*252 as annual_return, stddev_samp(ret)*sqrt(252) as annual_vol,
         avg(ret)/nullif(stddev_samp(ret), 0) as sharpe_ratio,
         avg(ret)/nullif(stddev_samp(ret), 0)*sqrt(252) as sharpe_annual,
         exp(sum(ln(1 + ret))) - 1 as total_return, count(ret) as n_obs
  from ports where quantile <> 'bmk_return' group by 1)"""


def ics(rows: str) -> str:
    """CTE ics from rows (dt, alpha, f): correlation of average ranks."""
    return f"""
ic_ranks as (
  select dt, rank() over (partition by dt order by alpha) + (count(*) over (partition by dt, alpha) - 1)/2e0 as ra,
         rank() over (partition by dt order by f) + (count(*) over (partition by dt, f) - 1)/2e0 as rf
  from {rows}),
ics as (
  select dt, case when stddev_pop(ra) > 0 and stddev_pop(rf) > 0
                  then covar_pop(ra, rf)/(stddev_pop(ra)*stddev_pop(rf)) end as ic
  from ic_ranks group by 1)"""


def weights(name: str, signal: str, flat: bool = True, neutral: bool = True) -> str:
    """CTE of mean-variance weights (dt, asset, weight)."""
    least = int(flat) + int(neutral) + 1
    known = "alpha is not null and specific_risk is not null" + (" and predicted_beta is not null" if neutral else "")
    sums = f"""{name}_sums as (
  select dt, count(*) as n, sum(1/pow(specific_risk, 2)) as s1, sum(predicted_beta/pow(specific_risk, 2)) as sb,
         sum(pow(predicted_beta, 2)/pow(specific_risk, 2)) as sbb, sum(alpha/pow(specific_risk, 2)) as sa,
         sum(alpha*predicted_beta/pow(specific_risk, 2)) as sab
  from {signal} where {known} group by 1)"""
    if flat and neutral:
        shift, tilt = "(sa*sbb - sab*sb)/(s1*sbb - sb*sb)", "(s1*sab - sb*sa)/(s1*sbb - sb*sb)"
        sound = f"n > {least} and s1*sbb - sb*sb > 1e-9*s1*sbb"
    elif flat:
        shift, tilt, sound = "sa/s1", "0e0", f"n > {least}"
    elif neutral:
        shift, tilt, sound = "0e0", "sab/sbb", f"n > {least} and sbb > 0"
    else:
        shift, tilt, sound = "0e0", "0e0", "true"
    return sums + f""",
{name} as (
  select s.dt, s.asset, (s.alpha - {shift} - {tilt}*s.predicted_beta)/(591*pow(s.specific_risk, 2)) as weight
  from {signal} s join {name}_sums t on t.dt = s.dt where {known} and {sound})"""


def returns(name: str, source: str) -> str:
    return f"""{name} as (
  select w.dt, coalesce(sum(w.weight*a.ret/100), 0e0) as ret
  from {source} w left join assets a on a.dt = w.dt and a.asset = w.asset group by 1)"""


def factor_risk() -> list[str]:
    """CTEs up to fcov (dt and f_i_j) and fw: weights from a Gauss-Jordan elimination per date."""
    names, keep, g = [f"IND_{x}" for x in INDUSTRIES], "(1e0 - 2e0/64)", 591
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ", ".join([f"sum(p*b.{n}) as s_{i}" for i, n in enumerate(names)] + [f"sum(p*b.{names[i]}*b.{names[j]}) as s_{i}_{j}" for i, j in pairs])
    cov = ", ".join(f"case when n >= 60 then (s_{i}_{j}/w - s_{i}*s_{j}/(w*w))/(1 - ww/(w*w)) end as f_{i}_{j}" for i, j in pairs)
    covariance = f"""
frows as (select *, row_number() over (order by dt) as rn from factors),
fsums as (
  select a.dt, count(*) as n, sum(p) as w, sum(p*p) as ww, {sums}
  from frows a join (select * from frows) b on b.rn <= a.rn, lateral (select pow({keep}, a.rn - b.rn) as p) group by 1),
fcov as (select dt, {cov} from fsums)"""
    z = [f"x_{i}" for i in range(k)] + ["alpha", "one", "beta"]
    total = " + ".join(f"coalesce(e.{n}, 0)" for n in names)
    shares = ", ".join(f"case when ({total}) > 0 then coalesce(e.{n}, 0)/({total}) else 0e0 end as x_{i}" for i, n in enumerate(names))
    moments = ", ".join(f"sum(p*{z[i]}*{z[j]}) as m_{i}_{j}" for i in range(k + 3) for j in range(i, k + 3))

    def m(i, j):
        return f"m_{min(i, j)}_{max(i, j)}"

    def times(i, j):
        return " + ".join(f"f_{min(i, c)}_{max(i, c)}*{m(c, j)}" for c in range(k))

    lines = [[f"{int(i == j)} + {times(i, j)}" for j in range(k)] + [times(i, k + 1), times(i, k + 2), times(i, k)] for i in range(k)]
    lines += [[m(j, a) for j in range(k)] + [m(k + 1, a), m(k + 2, a), m(k, a)] for a in (k + 1, k + 2)]
    matrix = "[" + ", ".join("[" + ", ".join(f"cast({c} as double)" for c in line) + "]" for line in lines) + "]"
    n = k + 2
    return [EXPOSURES, FACTORS, covariance, f"""
frisk as (
  select s.dt, s.asset, s.alpha, 1e0 as one, s.predicted_beta as beta, 1/pow(s.specific_risk, 2) as p, {shares}
  from sig s left join exposures e on e.dt = s.dt and e.asset = s.asset),
fmoments as (select dt, count(*) as n, {moments} from frisk group by 1),
gauss as (
  select dt, 1 as step, {matrix} as a from fmoments join fcov using (dt)
  where n > 3 and {m(k + 1, k + 1)}*{m(k + 2, k + 2)} - pow({m(k + 1, k + 2)}, 2) > 1e-9*{m(k + 1, k + 1)}*{m(k + 2, k + 2)} and f_0_0 is not null
  union all
  select dt, step + 1, list_transform(a, lambda row, i: case when i = step then top else list_transform(row, lambda v, j: v - row[step]*top[j]) end)
  from (select dt, step, a, list_transform(a[step], lambda v: v/a[step][step]) as top from gauss where step <= {n})),
fw as (
  select r.dt, r.asset, p/{g}*(alpha - a[{k + 1}][{n + 1}] - a[{k + 2}][{n + 1}]*beta - ({" + ".join(f"a[{i + 1}][{n + 1}]*x_{i}" for i in range(k))})) as weight
  from frisk r join gauss s on s.dt = r.dt and s.step = {n + 1})"""]


BOUNDED = """
bq as (select dt, asset, alpha, 0.05e0*pow(specific_risk, 2) as q from sig),
bounds as (select *, alpha - q*0.2e0 as full_at, alpha as none_at, count(*) over (partition by dt) as n from bq),
marks as (select distinct dt, unnest([full_at, none_at]) as l from bounds where n*0.2e0 >= 1),
sums as (select m.dt, m.l, sum(least(greatest((b.alpha - m.l)/b.q, 0), 0.2e0)) as total from marks m join bounds b on b.dt = m.dt group by 1, 2),
ends as (select dt, max(l) filter (total >= 1) as lo, min(l) filter (total <= 1) as hi from sums group by 1),
solved as (
  select e.dt, coalesce((sum(alpha/q) filter (full_at <= lo and none_at >= hi) + coalesce(sum(0.2e0) filter (full_at >= hi), 0) - 1)
                        / sum(1/q) filter (full_at <= lo and none_at >= hi), any_value(lo)) as l
  from ends e join bounds b on b.dt = e.dt where lo < hi group by 1
  union all select dt, lo from ends where lo >= hi),
bw as (select b.dt, b.asset, least(greatest((alpha - l)/q, 0), 0.2e0) as weight from bounds b join solved s on s.dt = b.dt)"""

WEIGHTS = [*SIGNAL, weights("w", "sig")]
PORTFOLIO = [*WEIGHTS, returns("port", "w")]
LEVERAGE = "lev as (select dt, coalesce(sum(abs(weight)), 0e0) as leverage from w group by 1)"
DRAWDOWN = """dd as (
  select dt, exp(lv - max(lv) over (order by dt)) - 1 as drawdown
  from (select dt, sum(ln(1 + ret)) over (order by dt) as lv from port))"""
TURNOVER = """turn as (
  select dt, coalesce(sum(abs(change)), 0e0) as two_sided_turnover
  from (select dt, weight - lag(weight) over (partition by asset order by dt) as change from w) group by 1)"""


def regression(source: str, by: str | None) -> list[str]:
    """CTEs up to terms: least squares on three factors by cofactors of the covariance matrix."""
    k = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    pairs = [("mktrf", "a"), ("smb", "b"), ("hml", "c")]
    cov = ", ".join(f"covar_pop({x}, {y}) as {i}{j}" for x, i in pairs for y, j in pairs if i <= j)
    cross = ", ".join(f"covar_pop({x}, ret) as r{i}" for x, i in pairs)
    moments = f"""
joined as (select {k}p.dt, ret, mktrf, smb, hml from {source} p join factor_model f on f.dt = p.dt
           where ret is not null and mktrf is not null and smb is not null and hml is not null),
mom as (select {k}count(*) as n, avg(ret) as my, avg(mktrf) as ma, avg(smb) as mb, avg(hml) as mc, {cov}, {cross},
               var_pop(ret) as yy from joined {group}),
cof as (select *, bb*cc - bc*bc as iaa, ac*bc - ab*cc as iab, ab*bc - ac*bb as iac, aa*cc - ac*ac as ibb,
               ab*ac - aa*bc as ibc, aa*bb - ab*ab as icc from mom),
inv as (select *, aa*iaa + ab*iab + ac*iac as det from cof),
beta as (select *, (iaa*ra + iab*rb + iac*rc)/det as ta, (iab*ra + ibb*rb + ibc*rc)/det as tb,
                (iac*ra + ibc*rb + icc*rc)/det as tc from inv),
fit as (select *, greatest(n*(yy - ta*ra - tb*rb - tc*rc), 0) as rss, my - ta*ma - tb*mb - tc*mc as t0,
               (ma*(iaa*ma + iab*mb + iac*mc) + mb*(iab*ma + ibb*mb + ibc*mc) + mc*(iac*ma + ibc*mb + icc*mc))/det as lev
        from beta)"""
    lines = [("intercept", "t0", "(1 + lev)/n", "t0*252"), ("mktrf", "ta", "iaa/det/n", "cast(null as double)"),
             ("smb", "tb", "ibb/det/n", "cast(null as double)"), ("hml", "tc", "icc/det/n", "cast(null as double)")]
    terms = "terms as (" + " union all ".join(
        f"select {k}'{t}' as term, {c} as coefficient, sqrt(rss/(n - 4)*{v}) as std_error, {y} as annualised,"
        f" 1 - rss/(n*yy) as r_squared, n as n_obs from fit" for t, c, v, y in lines) + ")"
    return [FACTOR_MODEL, moments, terms]


def regression_select(by: str | None) -> str:
    k = f"{by}, " if by else ""
    return (f"select {k}term, {r('coefficient', 'coefficient', 12)}, {r('std_error', 'std_error', 12)},"
            f" {r('coefficient/nullif(std_error, 0)', 't_stat', 8)}, {r('annualised', 'annualised', 12)},"
            f" {r('r_squared', 'r_squared', 10)}, n_obs from terms")


IDIOSYNCRATIC = [ASSETS, own_signal("idiosyncratic", "specific_return")]
THREE = [
    ASSETS, own_signal("standard", "ret"),
    own_signal("idiosyncratic", "specific_return").replace(ASSETS_FRACTION + ",\n", "", 1),
    *industry_parts(SHARES_ZERO),
]
NAMES = ["standard", "industry", "idiosyncratic"]
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1:]]
THREE_RETURNS = [*THREE] + [part for n in NAMES for part in (
    f"{n}_sig as (select * from {n} where alpha is not null)", weights(f"{n}_w", f"{n}_sig"), returns(f"{n}_ret", f"{n}_w"))]
ALIGNED = """aligned as (
  select s.dt, s.ret as standard, i.ret as industry, d.ret as idiosyncratic
  from standard_ret s left join industry_ret i on i.dt = s.dt left join idiosyncratic_ret d on d.dt = s.dt)"""


def corr(a: str, b: str, name: str) -> str:
    return r(f"corr({a}, {b})", name)


def query(parts: list[str], select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select


def _series(name: str) -> str:
    digits = {"ret": 9, "momentum_zscore": 7, "alpha": 6, "signal": 7, "price_lag": 12}
    return f"select asset, {d()}, {', '.join(r(c, c, n) for c, n in digits.items())} from {name}"


def build() -> dict[str, str]:
    wide = [f"IND_{x}" for x in INDUSTRIES]
    ports = ["p_1", "p_2", "p_3", "p_4", "p_5", "spread", "bmk_return"]
    moments = ("count(signal) as n, avg(signal) as m, stddev_samp(signal) as s, stddev_pop(signal) as sp")
    found = {
        "load_panel": query([ASSETS], f"""select asset, {d()}, {r('ret/100', 'ret', 10)}, {r('price', 'price', 12)} from assets
            where dt between date '1996-01-01' and date '2000-12-31'"""),
        "exposures_wide": query([EXPOSURES], f"select asset, {d()}, {', '.join(r(c, c) for c in wide)} from exposures"),
        "factors_wide": query([FACTORS], f"select {d()}, {', '.join(r(c, c) for c in wide)} from factors"),
        "factors_long": query([FACTORS, FACTORS_LONG], f"select {d()}, industry, {r('ret', 'ret')} from factors_long"),
        "normalise_exposures_zero": query([EXPOSURES, EXPOSURES_LONG, SHARES_ZERO],
                                          f"select {d()}, asset, industry, {r('exposure', 'exposure')} from shares"),
        "normalise_exposures_drop": query([EXPOSURES, EXPOSURES_LONG, SHARES_DROP],
                                          f"select {d()}, asset, industry, {r('exposure', 'exposure')} from shares"),
        "drop_nulls_wide": query([FACTOR_MODEL], f"""select {d()}, {r('mktrf', 'mktrf', 8)}, {r('smb', 'smb', 8)},
            {r('hml', 'hml', 8)} from factor_model where mktrf is not null and smb is not null and hml is not null"""),
        "ewm_std_min22": query([ASSETS, ASSETS_FRACTION, ewm("e", "fraction", "asset", "ret", 22)],
                               f"select asset, {d()}, {r('vol', 'vol', 8)} from e_vol"),
        "ewm_std_blocks": query([ASSETS, ASSETS_FRACTION, ewm("e", "fraction", "asset", "ret", 22)],
                                f"select asset, {d()}, {r('vol', 'vol', 8)} from e_vol"),
        "ewm_std_min1": query([FACTORS, FACTORS_LONG, ewm("e", "factors_long", "industry", "ret", 1)],
                              f"select industry, {d()}, {r('vol', 'vol')} from e_vol"),
        "rolling_sum_230": query([ASSETS, ASSETS_FRACTION], f"""select asset, {d()}, {r('total', 'total')} from (
            select *, case when count(ret) over f = 230 then sum(ret) over f end as total from fraction
            window f as (partition by asset order by dt rows between 229 preceding and current row))"""),
        "lag_22": query([ASSETS, ASSETS_FRACTION], f"""select asset, {d()}, {r('ret', 'ret')}, {r('l', 'ret_lag')} from (
            select *, lag(ret, 22) over (partition by asset order by dt) as l from fraction)"""),
        "price_lag": query([ASSETS], f"""select asset, {d()}, {r('price', 'price', 12)}, {r('l', 'price_lag', 12)} from (
            select *, lag(price) over (partition by asset order by dt) as l from assets) where l > 5"""),
        "vol_scaled_momentum": query([ASSETS, ASSETS_FRACTION, momentum("m", "fraction", "asset", "ret", 22)],
            f"select asset, {d()}, {r('scaled_ret', 'scaled_ret')}, {r('momentum', 'momentum')} from m"),
        "factor_momentum": query([FACTORS, FACTORS_LONG, FACTOR_MOMENTUM],
            f"select {d()}, industry, {r('vol', 'vol')}, {r('momentum', 'momentum')} from factor_momentum"),
        "cs_zscore": query([ASSETS], f"""select asset, {d()}, {r('price', 'price', 12)}, {r('z', 'price_z', 9)} from (
            select *, (price - avg(price) over (partition by dt))
                      / nullif(stddev_samp(price) over (partition by dt), 0) as z from assets)"""),
        "alpha": query([ASSETS], f"""select asset, {d()}, {r('z', 'signal', 8)}, {r('z*0.5*specific_risk', 'alpha', 8)} from (
            select *, (ret - avg(ret) over (partition by dt))
                      / nullif(stddev_samp(ret) over (partition by dt), 0) as z from assets)"""),
        "project_exposures": query(industry_parts(SHARES_ZERO)[:-1],
            f"select {d()}, asset, {r('momentum_score', 'momentum_score')} from scores"),
        "standard_momentum": query(STANDARD, _series("standard")),
        "idiosyncratic_momentum": query(IDIOSYNCRATIC, _series("idiosyncratic")),
        "industry_momentum": query([ASSETS, *industry_parts(SHARES_ZERO)], _series("industry")),
        "industry_momentum_drop": query([ASSETS, *industry_parts(SHARES_DROP)], _series("industry")),
        "sample_in": query(SIGNAL, f"""select asset, {d()}, {r('alpha', 'alpha')}, {r('ret', 'ret')} from sig
            where dt <= date '1999-06-30'"""),
        "sample_out": query(SIGNAL, f"""select asset, {d()}, {r('alpha', 'alpha')}, {r('ret', 'ret')} from sig
            where dt > date '1999-06-30'"""),
        "sample_summary": query(SIGNAL, """select strftime(min(dt), '%Y-%m-%d') as first_date,
            strftime(max(dt), '%Y-%m-%d') as last_date, count(distinct dt) as n_dates from sig"""),
        "signal_stats": query([*SIGNAL, f"mo as (select {moments} from sig)"], f"""select any_value(n) as count,
            count(*) filter (where signal is null) as null_count,
            count(*) filter (where not isfinite(signal)) as nonfinite_count, {r('any_value(m)', 'mean')},
            {r('any_value(s)', 'std')}, {r('min(signal)', 'min')}, {r('quantile_cont(signal, 0.25)', 'p25')},
            {r('quantile_cont(signal, 0.5)', 'p50')}, {r('quantile_cont(signal, 0.75)', 'p75')},
            {r('max(signal)', 'max')}, {r('avg(pow((signal - m)/sp, 3))', 'skew')},
            {r('avg(pow((signal - m)/sp, 4)) - 3', 'kurtosis')} from sig, mo"""),
        "signal_histogram": query([*SIGNAL, "lim as (select min(signal) as lo, max(signal) as hi from sig)", """
            placed as (select least(floor((signal - lo)/(hi - lo)*50), 49) as bin from sig, lim)"""], f"""
            select cast(i as bigint) as bin, {r('lo + i*((hi - lo)/50)', '"left"')},
                   {r('lo + (i + 1)*((hi - lo)/50)', '"right"')},
                   (select count(*) from placed where placed.bin = i) as count
            from lim, range(50) t(i)"""),
        "quantile_portfolios": query(QUANTILES, f"select {d()}, {', '.join(r(c, c, 10) for c in ports)} from wide"),
        "portfolios_long": query(QUANTILES, f"select {d()}, quantile, {r('ret', 'ret', 10)} from ports"),
        "quantile_cumulative": query(QUANTILES, f"""select {d()}, quantile, {r('c', 'cum_return')} from (
            select *, 100*sum(ln(1 + ret)) over (partition by quantile order by dt) as c from ports)"""),
        "portfolio_metrics": query([*QUANTILES, METRICS], "select quantile, " + ", ".join(r(c, c) for c in [
            "annual_return", "annual_vol", "sharpe_ratio", "sharpe_annual", "total_return"]) + ", n_obs from metrics"),
        "spread_headline": query([*QUANTILES, METRICS, ics("fwd")], f"""
            select {r('sharpe_ratio', 'spread_sharpe')}, {r('annual_return', 'spread_annual_return')},
                   {r('(select avg(ic) from ics)', 'ic_mean')},
                   {r('(select avg(ic)/stddev_samp(ic) from ics)', 'ic_ir')} from metrics where quantile = 'spread'"""),
        "rank_ic": query([*SIGNAL, FORWARD, ics("fwd")], f"select {d()}, {r('ic', 'ic')} from ics"),
        "rank_ic_joined": query([*SIGNAL, """pairs as (
            select a.dt, a.asset, a.alpha, b.ret as f from sig a join sig b on b.dt = a.dt and b.asset = a.asset
            where b.ret is not null)""", ics("pairs")], f"select {d()}, {r('ic', 'ic')} from ics"),
        "ic_summary": query([*SIGNAL, FORWARD, ics("fwd")],
            f"select {r('avg(ic)', 'ic_mean')}, {r('avg(ic)/stddev_samp(ic)', 'ic_ir')} from ics"),
        "cumulative_ic": query([*SIGNAL, FORWARD, ics("fwd")], f"""select {d()}, {r('ic', 'ic')},
            {r('c', 'cumulative_ic')} from (select *, sum(coalesce(ic, 0)) over (order by dt) as c from ics)"""),
        "quantile_regression": query([*QUANTILES, *regression("ports", "quantile")], regression_select("quantile")),
        "mv_weights": query(WEIGHTS, f"select {d()}, asset, {r('weight', 'weight', 9)} from w"),
        "mv_weights_free": query([*SIGNAL, weights("w", "sig", False, False)],
                                 f"select {d()}, asset, {r('weight', 'weight', 9)} from w"),
        "mv_weights_zero_investment": query([*SIGNAL, weights("w", "sig", True, False)],
                                            f"select {d()}, asset, {r('weight', 'weight', 9)} from w"),
        "mv_weights_zero_beta": query([*SIGNAL, weights("w", "sig", False, True)],
                                      f"select {d()}, asset, {r('weight', 'weight', 9)} from w"),
        "factor_covariance": query([FACTORS, factor_risk()[2]], " union all ".join(
            f"select {d()}, {i} as i, {j} as j, {r(f'f_{i}_{j}', 'covariance', 9)} from fcov" for i in range(6) for j in range(i, 6))),
        "mv_weights_factor_risk": query([*SIGNAL, *factor_risk()], f"select {d()}, asset, {r('weight', 'weight', 9)} from fw"),
        "mv_weights_bounded": query([*SIGNAL, BOUNDED], f"select {d()}, asset, {r('weight', 'weight', 9)} from bw"),
        "portfolio_returns": query(PORTFOLIO, f"select {d()}, {r('ret', 'ret', 12)} from port"),
        "leverage": query([*WEIGHTS, LEVERAGE], f"select {d()}, {r('leverage', 'leverage', 9)} from lev"),
        "leverage_summary": query([*WEIGHTS, LEVERAGE], "select " + ", ".join(
            r(f"{f}(leverage)", f"{n}_leverage", 9)
            for f, n in [("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_samp", "std")]) + " from lev"),
        "drawdown": query([*PORTFOLIO, DRAWDOWN], f"select {d()}, {r('drawdown', 'drawdown', 9)} from dd"),
        "drawdown_summary": query([*PORTFOLIO, DRAWDOWN, """runs as (
            select *, row_number() over (order by dt) - row_number() over (partition by drawdown < 0 order by dt) as run
            from dd)"""], f"""select {r('avg(drawdown)', 'mean_drawdown', 9)}, {r('min(drawdown)', 'max_drawdown', 9)},
            {r('(select drawdown from dd order by dt desc limit 1)', 'current_drawdown', 9)},
            (select coalesce(max(n), 0) from (select count(*) as n from runs where drawdown < 0 group by run)) as longest_drawdown
            from dd"""),
        "returns_summary": query(PORTFOLIO, f"""select count(ret) as count, {r('avg(ret)*252', 'mean_annual_return', 11)},
            {r('stddev_samp(ret)*sqrt(252)', 'volatility', 11)}, {r('exp(sum(ln(1 + ret))) - 1', 'total_return', 11)},
            {r('avg(ret)*252/(stddev_samp(ret)*sqrt(252))', 'sharpe', 11)} from port"""),
        "cumulative_return": query(PORTFOLIO, f"""select {d()}, 'standard' as strategy, {r('c', 'cum_return')} from (
            select *, 100*sum(ln(1 + ret)) over (order by dt) as c from port)"""),
        "turnover": query([*WEIGHTS, TURNOVER], f"""select {d()}, {r('t', 'two_sided_turnover', 9)} from (
            select *, case when count(*) over f = 252 then avg(two_sided_turnover) over f end as t from turn
            window f as (order by dt rows between 251 preceding and current row))"""),
        "turnover_summary": query([*WEIGHTS, TURNOVER], "select " + ", ".join(
            r(f"{f}(two_sided_turnover)", f"{n}_two_sided_turnover", 9)
            for f, n in [("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_samp", "std")]) + " from turn"),
        "portfolio_regression": query([*PORTFOLIO, *regression("port", None)], regression_select(None)),
        "align_strategies": query([*THREE_RETURNS, ALIGNED],
            f"select {d()}, {', '.join(r(n, n, 9) for n in NAMES)} from aligned"),
        "strategy_correlation": query([*THREE_RETURNS, ALIGNED],
            "select " + ", ".join(corr(a, b, f"{a}_vs_{b}") for a, b in PAIRS) + " from aligned"),
        "signal_correlation": query(THREE, "select " + ", ".join(
            f"(select {r('corr(a.signal, b.signal)', 'c')} from {a} a join {b} b on b.dt = a.dt and b.asset = a.asset) as {a}_vs_{b}"
            for a, b in PAIRS)),
        "strategy_comparison": query([*THREE_RETURNS, "stacked as (" + " union all ".join(
            f"select '{n}' as strategy, * from {n}_ret" for n in NAMES) + ")"], f"""
            select strategy, count(ret) as count, {r('avg(ret)*252', 'mean_annual_return', 11)},
            {r('stddev_samp(ret)*sqrt(252)', 'volatility', 11)}, {r('exp(sum(ln(1 + ret))) - 1', 'total_return', 11)},
            {r('avg(ret)*252/(stddev_samp(ret)*sqrt(252))', 'sharpe', 11)} from stacked group by 1"""),
        "universe_panel": query([ASSETS], f"""select asset, {d()}, {r('price', 'price', 12)} from assets
            where price > 13 and dt between date '1996-01-01' and date '2000-12-31'"""),
        "glob_union": query(SIGNAL, f"select asset, {d()}, {r('alpha', 'alpha')}, {r('ret', 'ret')} from sig"),
        "total_loss": query([ASSETS, """
            grown as (select asset, dt, ret/100*12.5e0 as ret,
                             max(case when ret/100*12.5e0 <= -1 then 1 else 0 end) over w as lost,
                             sum(ln(nullif(greatest(1 + ret/100*12.5e0, 0), 0))) over w as lv
                      from assets window w as (partition by asset order by dt)),
            dd as (select *, case when lost = 1 then -1e0 else exp(lv - max(lv) over w) - 1 end as drawdown
                   from grown window w as (partition by asset order by dt)),
            runs as (select *, row_number() over (partition by asset order by dt)
                               - row_number() over (partition by asset, drawdown < 0 order by dt) as run from dd),
            longest as (select asset, max(n) as n from (
                select asset, run, count(*) as n from runs where drawdown < 0 group by 1, 2) group by 1)"""], f"""
            select asset, count, mean_annual_return, {r('case when total > 1 then log10(total) else total end', 'total_return', 9)},
                   mean_drawdown, max_drawdown, current_drawdown, longest_drawdown from (
            select dd.asset, count(ret) as count, {r('avg(ret)*252', 'mean_annual_return', 9)},
                   case when max(lost) = 1 then -1e0 else exp(sum(ln(nullif(greatest(1 + ret, 0), 0)))) - 1 end as total,
                   {r('avg(drawdown)', 'mean_drawdown', 9)}, {r('min(drawdown)', 'max_drawdown', 9)},
                   {r('arg_max(drawdown, dt)', 'current_drawdown', 9)}, coalesce(any_value(n), 0) as longest_drawdown
            from dd left join longest on longest.asset = dd.asset group by 1)"""),
    }
    found["contract_counts"] = query([ASSETS], "select count(*) as rows, count(*) - count(distinct (asset, dt)) as repeated, " + ", ".join(
        f"count(*) filter ({c} is null) as null_{c}" for c in ("asset", "dt", "ret", "price", "specific_risk", "predicted_beta")) + " from assets")
    found["factor_gaps"] = query([FACTOR_MODEL, "long as (" + " union all ".join(
        f"select dt, '{c}' as factor, {c} as ret from factor_model" for c in ("mktrf", "smb", "hml")) + ")"], """
        select factor, count(*) as n_rows, count(*) filter (ret is null) as n_null, count(*) filter (rn >= 230 and recent > 0) as n_lost
        from (select *, row_number() over (partition by factor order by dt) as rn, count(*) filter (ret is null) over (
                  partition by factor order by dt rows between 229 preceding and current row) as recent from long) group by 1""")
    found["signal_replaced"] = found["glob_union"].replace("round(alpha, 6)", "round(-alpha, 6)")
    found["stored_panel"] = found["standard_momentum"]
    found["workflow_summary"] = found["returns_summary"]
    found["workflow_correlation"] = query([*THREE_RETURNS, ALIGNED],
        f"select {r('corr(standard, idiosyncratic)', 'standard_vs_idiosyncratic', 2)} from aligned")
    for name in ("rank_ic", "quantile_portfolios", "signal_stats"):
        found[f"{name}_ranges"] = found[name]
    found["project_exposures_sparse"] = found["project_exposures"]
    found["weights_round_trip"] = found["mv_weights"]
    return found
