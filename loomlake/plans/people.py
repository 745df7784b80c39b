"""People, profile facets and their budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators import profile as op
from loomlake.plans.catalog import query, stand_in

NOW = 1_706_700_000
STABLE = f"""fam as (select class, facet_key, cue, max(sec) as last, count(*) as n from facets group by 1, 2, 3),
 st as (select class, facet_key, round(sum(case cue when 'explicit' then 1.0 when 'structural' then 0.9 when 'behavioral' then 0.7 else 0.6 end * exp(-(({NOW} - last) / 86400.0) / 30) * ln(1 + n)) * case when bool_or(cue = 'explicit') then 2 else 1 end, 6) as stability from fam group by 1, 2)"""
stand_in("stable_facets", "select class, facet_key, count(*) as evidence, round(sum(confidence), 2) as stability from {facets} group by class, facet_key")


@query("person_score", ["interactions"], f"""with a as (select person_id, max(sec) as last, count(*) filter (({NOW} - sec) / 86400.0 <= 30) as n, count(*) filter (is_outbound) as o, count(*) filter (not is_outbound) as i, avg(length) as m from interactions group by 1),
 p as (select person_id, least(greatest(exp(-(({NOW} - last) / 86400.0) * ln(2) / 14), 0), 1) as recency, least(n / 50.0, 1) as frequency, case when greatest(o, i) = 0 then 0 else least(o, i) / greatest(o, i) end as reciprocity, least(m / 500.0, 1) as depth from a)
 select person_id, round(recency, 6) as recency, round(frequency, 6) as frequency, round(reciprocity, 6) as reciprocity, round(depth, 6) as depth, round(recency * frequency * reciprocity * depth, 6) as score from p""")
def person_score(interactions: DataFrame) -> DataFrame:
    return op.person_scores(interactions, F.lit(NOW))


@query("profile_by_class", ["stable_facets"], "select case when facet_key like '%/%' then split_part(facet_key, '/', 1) else '_other' end as class, count(*) as n from stable_facets where stability >= 1 group by 1")
def profile_by_class(facets: DataFrame) -> DataFrame:
    prefix = F.when(F.col("facet_key").contains("/"), F.split_part("facet_key", F.lit("/"), F.lit(1))).otherwise("_other")
    return facets.where("stability >= 1").groupBy(prefix.alias("class")).agg(F.count("*").alias("n"))


@query("profile_render", ["stable_facets"], """select class, '## ' || class || chr(10) || string_agg('- ' || facet_key || ' (confirmed ' || cast(evidence as varchar) || 'x)', chr(10) order by facet_key) as section from stable_facets group by class""")
def profile_render(facets: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), "facet_key", F.lit(" (confirmed "), "evidence", F.lit("x)"))
    lines = F.array_sort(F.collect_list(F.struct("facet_key", line.alias("line"))))
    by = facets.groupBy("class").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    return by.select("class", F.concat(F.lit("## "), "class", F.lit("\n"), "body").alias("section"))


@query("stability", ["facets"], f"with {STABLE} select class, facet_key, stability from st")
def stability(facets: DataFrame) -> DataFrame:
    return op.stability(facets, F.lit(NOW))


@query("facet_budget", ["facets"], f"""with {STABLE},
 r as (select *, row_number() over (partition by class order by stability desc, facet_key) <= case class when 'style' then 4 when 'identity' then 4 when 'tooling' then 5 else 3 end as placed from st),
 o as (select class, facet_key from r where not placed order by stability desc, class, facet_key limit 5)
 select r.class, r.facet_key, stability, case when stability >= 1.5 then 'active' when stability >= 0.7 then 'provisional' when stability >= 0.4 then 'candidate' else 'dropped' end as state, placed or o.class is not null as kept
 from r left join o on o.class = r.class and o.facet_key = r.facet_key""")
def facet_budget(facets: DataFrame) -> DataFrame:
    return op.budgeted(op.stability(facets, F.lit(NOW)))


@query("prompt_facets", ["stable_facets"], "select class, facet_key, stability from stable_facets order by class, stability desc, facet_key limit 20")
def prompt_facets(facets: DataFrame) -> DataFrame:
    return facets.orderBy("class", F.desc("stability"), "facet_key").limit(20).select("class", "facet_key", "stability")
