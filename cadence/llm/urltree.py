"""URL filters by path-template trees.

Each host has a tree of path segments. Going down, a segment stays literal if it is the only one at its place, or if it is frequent
and the pages below it differ from those below its siblings in their share of bad labels; all others at that place are variable or
statistically alike and become one wildcard branch. Literal segments that, in the order of their shares, don't differ from the one before are
merged to one branch too. A path's template is what it has become at the bottom. Templates are rejected by
their smoothed share of bad labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.session import cut

DEPTH, MIN_COUNT, MIN_SHARE, CHI2, PRIOR, MIN_LABELS, REJECT = 5, 10, 0.02, 3.841459, 5.0, 3, 0.5

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_TEST = """n = tn or (n >= {least} and lab > 0 and tlab > lab and tbad > 0 and tbad < tlab and
    pow(cast(bad as double) / lab - cast(tbad - bad as double) / (tlab - lab), 2)
    > {chi2}e0 * (cast(tbad as double) / tlab) * (1 - cast(tbad as double) / tlab) * (1e0 / lab + 1e0 / (tlab - lab)))"""
_LITERAL = _TEST.format(least=MIN_COUNT, chi2=CHI2)
#: What the SQL adds: it keeps to five levels and to branches of MIN_SHARE, which agrees where no host has rarer ones.
_SQL_LITERAL = _TEST.format(least=f"{MIN_COUNT} and n >= {MIN_SHARE}e0 * tn", chi2=CHI2)
#: Whether a branch differs from the one before, by labels (lab, bad) and (plab, pbad).
_DIFFERS = f"""pow(cast(bad as double) / nullif(lab, 0) - cast(pbad as double) / nullif(plab, 0), 2)
    > {CHI2}e0 * (cast(bad + pbad as double) / nullif(lab + plab, 0)) * (1 - cast(bad + pbad as double) / nullif(lab + plab, 0)) * (1e0 / nullif(lab, 0) + 1e0 / nullif(plab, 0))"""
_GLOBAL = "(coalesce(gbad, 0) + 1e0) / (coalesce(glab, 0) + 2e0)"
_HOST_RATE = f"(hbad + {PRIOR}e0 * ({_GLOBAL})) / (hlab + {PRIOR}e0)"
_PURITY = f"(bad + {PRIOR}e0 * ({_HOST_RATE})) / (lab + {PRIOR}e0)"


def url_templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, template, n_pages, n_labelled, bad_share, rejected): one row for each row of pages.

    A page is bad if its label, by page_id, says low quality or toxic; of several labels the worst holds, null labels don't
    count. Query and fragment are ignored; the tree is as deep as the longest path, and no url is too long. In a template * stands for segments without a branch of their own, {a|z|n} for a
    merged branch of n segments from a to z. Segments of equal shares are put in order by name. bad_share is the template's share of bad labels,
    drawn towards its host's by PRIOR labels, which in turn is drawn towards that of all. A template of MIN_LABELS labels or more and a bad_share of
    REJECT or more is rejected. A page without a url, or with one that has no scheme and host, has a null host and is not rejected. Repeated
    rows count each. Without labels nothing is rejected. Other columns are not read.
    """
    worst = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long")).alias("bad"))
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    segments = F.filter(F.split(F.regexp_extract("url", _PATH, 1), "/"), lambda s: s != "")
    base = pages.select("page_id", F.when(host != "", host).alias("host"), segments.alias("p")).join(worst, "page_id", "left")
    base = cut(base.select("page_id", "host", "p", F.col("bad").isNotNull().cast("long").alias("lab"), F.coalesce("bad", F.lit(0)).alias("bad")))
    depth = base.where("host is not null").agg(F.max(F.size("p"))).first()[0] or 0
    now = base.withColumn("t", F.lit(""))
    totals = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    for d in range(depth):
        now = (now if d % 4 else cut(now)).withColumn("s", F.get("p", F.lit(d)))
        values = cut(now.where("host is not null and s is not null").groupBy("host", "t", "s").agg(F.count("*").alias("n"), *totals[1:]))
        parents = values.groupBy("host", "t").agg(*(F.sum(c).alias(f"t{c}") for c in ("n", "lab", "bad")))
        literal = values.join(parents, ["host", "t"]).where(_LITERAL).withColumn("share", F.when(F.col("lab") > 0, F.col("bad").cast("double") / F.col("lab")))
        order = W.partitionBy("host", "t").orderBy("share", "s")
        literal = literal.withColumns({"plab": F.lag("lab").over(order), "pbad": F.lag("bad").over(order)}).withColumn("group", F.sum(F.expr(f"case when {_DIFFERS} then 1 else 0 end")).over(order))
        each = W.partitionBy("host", "t", "group")
        name = F.when(F.count("*").over(each) == 1, F.col("s")).otherwise(F.concat(F.lit("{"), F.min("s").over(each), F.lit("|"), F.max("s").over(each), F.lit("|"), F.count("*").over(each).cast("string"), F.lit("}")))
        literal = cut(literal.select("host", "t", "s", name.alias("name")))
        now = now.join(literal, ["host", "t", "s"], "left")
        now = now.withColumn("t", F.when(F.col("s").isNull(), F.col("t")).otherwise(F.concat("t", F.lit("/"), F.coalesce("name", F.lit("*"))))).drop("name")
    placed = now.select("page_id", "host", F.when(F.col("host").isNotNull(), F.when(F.col("t") == "", "/").otherwise(F.col("t"))).alias("template"), "lab", "bad")
    placed = cut(placed)
    kinds = placed.where("host is not null").groupBy("host", "template").agg(F.count("*").alias("n"), *totals[1:])
    hosts = placed.where("host is not null").groupBy("host").agg(F.sum("lab").alias("hlab"), F.sum("bad").alias("hbad"))
    every = placed.agg(F.sum("lab").alias("glab"), F.sum("bad").alias("gbad"))
    rated = kinds.join(hosts, "host").crossJoin(F.broadcast(every)).withColumn("share", F.expr(_PURITY))
    rated = rated.select("host", "template", F.col("n").alias("n_pages"), F.col("lab").alias("n_labelled"), F.round("share", 9).alias("bad_share"), F.expr(f"lab >= {MIN_LABELS} and round(share, 9) >= {REJECT}e0").alias("rejected"))
    return placed.select("page_id", "host", "template").join(rated, ["host", "template"], "left").select("page_id", "host", "template", "n_pages", "n_labelled", "bad_share", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, to DEPTH levels, the rest of a path as one segment, and with branches of MIN_SHARE or more."""
    steps = [f"p[{d + 1}] as s{d}" for d in range(DEPTH - 1)] + [f"case when len(p) >= {DEPTH} then array_to_string(p[{DEPTH}:], '/') end as s{DEPTH - 1}"]
    sql = f"""with worst as (select doc_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad from labels
    where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
parsed as (select page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') as host, list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda s: s <> '') as p from pages),
l0 as (select page_id, host, {', '.join(steps)}, case when bad is null then 0 else 1 end as lab, coalesce(bad, 0) as bad, '' as t from parsed left join worst on page_id = doc_id)"""
    for d in range(DEPTH):
        sql += f""",
v{d} as (select host, t, s{d}, count(*) as n, sum(lab) as lab, sum(bad) as bad from l{d} where host is not null and s{d} is not null group by host, t, s{d}),
w{d} as (select *, sum(n) over (partition by host, t) as tn, sum(lab) over (partition by host, t) as tlab, sum(bad) over (partition by host, t) as tbad from v{d}),
x{d} as (select *, case when lab > 0 then cast(bad as double) / lab end as share from w{d} where {_SQL_LITERAL}),
y{d} as (select *, lag(lab) over (partition by host, t order by share, s{d}) as plab, lag(bad) over (partition by host, t order by share, s{d}) as pbad from x{d}),
z{d} as (select *, sum(case when {_DIFFERS} then 1 else 0 end) over (partition by host, t order by share, s{d}) as g from y{d}),
m{d} as (select *, case when count(*) over (partition by host, t, g) = 1 then s{d} else '{{' || min(s{d}) over (partition by host, t, g) || '|' || max(s{d}) over (partition by host, t, g) || '|' || count(*) over (partition by host, t, g) || '}}' end as name from z{d}),
l{d + 1} as (select a.* replace (case when a.s{d} is null then a.t else a.t || '/' || coalesce(b.name, '*') end as t)
    from l{d} a left join m{d} b on a.host = b.host and a.t = b.t and a.s{d} = b.s{d})"""
    return sql + f""",
placed as (select page_id, host, case when host is not null then case when t = '' then '/' else t end end as template, lab, bad from l{DEPTH}),
kinds as (select host, template, count(*) as n, sum(lab) as lab, sum(bad) as bad from placed where host is not null group by host, template),
hosts as (select host, sum(lab) as hlab, sum(bad) as hbad from placed where host is not null group by host),
every as (select sum(lab) as glab, sum(bad) as gbad from placed),
rated as (select k.host, template, n, lab, round({_PURITY}, 9) as share from kinds k join hosts h on k.host = h.host cross join every)
select page_id, p.host, p.template, cast(n as bigint) as n_pages, cast(r.lab as bigint) as n_labelled, share as bad_share, coalesce(r.lab >= {MIN_LABELS} and share >= {REJECT}e0, false) as rejected
from placed p left join rated r on p.host = r.host and p.template = r.template"""
