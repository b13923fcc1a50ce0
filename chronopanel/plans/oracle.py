"""SQL fragments of the panels, for the queries' equivalents."""

OBS = """obs as (select user_id as entity, event_type as band, cast(datediff('day', date '2024-01-01', cast(ts as date)) // 2 as int) as step,
 median(value / 497) as v, count(value) as n from events where datediff('day', date '2024-01-01', cast(ts as date)) between 0 and 29 group by 1, 2, 3)"""
GRID = OBS + """, grid as (select e.entity, b.band, s.step, o.v, coalesce(o.n, 0) as n from (select distinct entity from obs) e
 cross join (select unnest(['click','error','purchase','signup','view']) as band) b cross join (select cast(unnest(range(0, 15)) as int) as step) s
 left join obs o on o.entity = e.entity and o.band = b.band and o.step = s.step)"""


def fill(source: str, name: str) -> str:
    return f"""{name} as (select entity, band, step, case when v is not null then v when pv is not null and nv is not null then pv + (nv - pv) * (step - ps) / (ns - ps) else coalesce(pv, nv) end as v
 from (select *, last_value(v ignore nulls) over a as pv, last_value(case when v is not null then step end ignore nulls) over a as ps,
 first_value(v ignore nulls) over b as nv, first_value(case when v is not null then step end ignore nulls) over b as ns from {source}
 window a as (partition by entity, band order by step rows between unbounded preceding and current row), b as (partition by entity, band order by step rows between current row and unbounded following)))"""


def smooth(source: str, name: str, last: int) -> str:
    return f"""{name} as (select entity, band, step, case
 when step = 0 then (31*v + 9*lead(v,1) over w - 3*lead(v,2) over w - 5*lead(v,3) over w + 3*lead(v,4) over w) / 35
 when step = 1 then (9*lag(v,1) over w + 13*v + 12*lead(v,1) over w + 6*lead(v,2) over w - 5*lead(v,3) over w) / 35
 when step = {last} then (31*v + 9*lag(v,1) over w - 3*lag(v,2) over w - 5*lag(v,3) over w + 3*lag(v,4) over w) / 35
 when step = {last - 1} then (9*lead(v,1) over w + 13*v + 12*lag(v,1) over w + 6*lag(v,2) over w - 5*lag(v,3) over w) / 35
 else (17*v + 12*(lag(v,1) over w + lead(v,1) over w) - 3*(lag(v,2) over w + lead(v,2) over w)) / 35 end as v
 from {source} window w as (partition by entity, band order by step))"""


FILLED = GRID + ", " + fill("grid", "filled")
SMOOTHED = FILLED + ", " + smooth("filled", "smoothed", 14)
WIDE = "wide as (select entity, step, " + ", ".join(f"max(v) filter (where band = '{b}') as {b}" for b in ("click", "error", "purchase", "signup", "view")) + " from filled group by 1, 2)"
MONTHS = """months as (select l_suppkey as entity, cast(date_trunc('month', l_shipdate) as date) as month_start, 'price' as band,
 avg(l_extendedprice / l_quantity / 1000) as v, cast((year(date_trunc('month', l_shipdate)) - 1995) * 12 + month(date_trunc('month', l_shipdate)) - 1 as int) as step from lineitem group by 1, 2, 3, 5)"""
POINTS = "points as (select vec_id, label, cast(embedding[1] as double) * 2 + 77.6 as lon, cast(embedding[2] as double) * 2 + 29.2 as lat from embeddings)"
SCORES = "scores as (select d.doc_id, d.source, d.lang, l.quality as y, (d.n_chars % 1000) / 1000.0::double as score from documents d join labels l using (doc_id))"


def rounded(names: str | list[str], digits: int = 6, alias: str | None = None) -> str:
    """round(x, digits) + 0.0 as x of each name; an expression has an alias."""
    if alias:
        return f"round({names}, {digits}) + 0.0 as {alias}"
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in (names.split() if isinstance(names, str) else names))
