"""Derived tables over the driver's tables: charts, articles, feedback, scores, games, audit log. SQL of each for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import params as P
from .operators.tables import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing event value of seven of the days that there are, top 50 of each chart and day."""
    e = table(spark, sf, "events")
    days = e.select(F.to_date("ts").alias("d")).distinct().agg(F.array_sort(F.collect_set("d")).alias("days"))
    sums = lambda df, v: df.groupBy("d", "p", "c", "b").agg(F.sum(v).alias("v"))
    rows = e.where("user_id is not null and event_type is not null").select(
        F.to_date("ts").alias("d"), F.when(F.col("user_id") % 2 == 0, "iOS").otherwise("Android").alias("p"), F.col("event_type").alias("c"), F.col("user_id").alias("b"),
        F.col("value").cast("decimal(12,2)").alias("v"),
    )
    # the rows of a user meet once: a day's value counts on that day and the six days after it
    base = sums(rows.repartition("p", "c", "b"), "v").join(F.broadcast(days))
    counted = base.withColumn("d", F.explode(F.slice("days", F.array_position("days", F.col("d")).cast("int"), F.lit(7)))).drop("days")
    grid = sums(counted, "v").withColumnRenamed("v", "s")
    ranked = grid.where("s > 0").withColumn("r", F.row_number().over(Window.partitionBy("d", "p", "c").orderBy(F.desc("s"), "b"))).where("r <= 50")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    named = ranked.join(part, ranked.b == part.p_partkey, "left").select(
        F.col("d").alias("date"), F.col("p").alias("platform"), F.col("c").alias("chart_type"), F.coalesce("p_type", F.lit("")).alias("category"),
        F.col("r").cast("int").alias("rank"), F.col("b").cast("string").alias("bundle_id"),
        F.concat(F.coalesce("p_name", F.lit("item")), F.lit(" "), F.col("b").cast("string")).alias("game_name"), F.col("p_brand").alias("developer"),
    )
    return stored(named, "charts")  # queries read them more than once


def _url() -> str:
    return "concat('https://', source, '.example.org/', cast(doc_id as string))"


def news(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "date_add(date '2024-01-01', cast(doc_id % 30 as int)) as date", "substring_index(text, '\n', 1) as headline", "source", f"{_url()} as url",
        "lang as category", "text as body", "date_add(date '2024-01-01', cast(doc_id % 30 - doc_id % 10 as int)) as publish_date",
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type in ('view', 'error', 'click')").withColumn("doc_id", F.get_json_object("props", "$.k").cast("long"))
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return e.join(d, "doc_id").selectExpr(
        "to_date(ts) as date", "case event_type when 'view' then 'thumbs_up' when 'error' then 'thumbs_down' else 'hot_click' end as feedback_type",
        f"{_url()} as news_url", "cast(user_id as string) as open_id", "lang as keyword", "event_id",
    )


def _of(labels: tuple[str, ...]) -> str:
    """Each label in turn, by document."""
    return f"case doc_id % {len(labels)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(labels)) + " end"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").selectExpr(
        f"{_url()} as url", "cast(least(100, greatest(0, 40 * quality - 20 * toxic + cast((doc_id * 37) % 50 as int))) as int) as score",
        f"case when quality = 1 then {_of(P.POS_LABELS)} else '' end as pos_label", f"case when quality = 0 then {_of(P.NEG_LABELS)} else '' end as neg_label", "substring_index(text, '\n', 1) as summary",
    )


def games(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "date_add(date '2024-01-01', cast(p_partkey % 30 as int)) as date", "concat(p_name, ' ', cast(p_partkey as string)) as game_name",
        "concat(p_type, '|', p_brand) as tags", "p_type as genre",
        "case when p_size >= 25 then concat(cast(p_size - 24 as string), '万+预约') else concat(cast(p_size * 100 as string), '预约') end as downloads",
        "p_partkey % 9 = 0 as is_port",
    )


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "cast(conv_id as string) as run_id", "cast(turn as int) as round_num", "role as tool_name", "cast(length(text) as int) as latency_ms", "turn % 2 = 1 as cache_hit"
    )


SQL = {
    "rankings": """base as (select cast(ts as date) d, case when user_id%2=0 then 'iOS' else 'Android' end p, event_type c, user_id b, sum(cast(value as decimal(12,2))) v from events group by 1,2,3,4),
days as (select distinct d from base), ents as (select distinct p,c,b from base),
grid as (select days.d, e.p, e.c, e.b, coalesce(base.v,0) v from days cross join ents e left join base on base.d=days.d and base.p=e.p and base.c=e.c and base.b=e.b),
roll as (select d,p,c,b, sum(v) over (partition by p,c,b order by d rows between 6 preceding and current row) s from grid),
rk as (select d,p,c,b, row_number() over (partition by d,p,c order by s desc, b) r from roll where s>0),
rankings as materialized (select rk.d as date, rk.p as platform, rk.c as chart_type, coalesce(x.p_type,'') as category, cast(rk.r as int) as rank, cast(rk.b as varchar) as bundle_id,
 coalesce(x.p_name,'item')||' '||cast(rk.b as varchar) as game_name, x.p_brand as developer
from rk left join part x on x.p_partkey=rk.b where rk.r<=50)""",
    "news": """news as materialized (select date '2024-01-01' + cast(doc_id%30 as int) as date, split_part(text, chr(10), 1) as headline, source,
'https://'||source||'.example.org/'||cast(doc_id as varchar) as url, lang as category, text as body,
date '2024-01-01' + cast(doc_id%30 as int) - cast(doc_id%10 as int) as publish_date from documents)""",
    "feedback": """feedback as materialized (select cast(ts as date) as date, case event_type when 'view' then 'thumbs_up' when 'error' then 'thumbs_down' else 'hot_click' end as feedback_type,
'https://'||d.source||'.example.org/'||cast(d.doc_id as varchar) as news_url, cast(e.user_id as varchar) as open_id, d.lang as keyword, e.event_id
from events e join documents d on d.doc_id = cast(json_extract_string(e.props,'$.k') as bigint) where e.event_type in ('view','error','click'))""",
    "scores": """scores as materialized (select 'https://'||d.source||'.example.org/'||cast(d.doc_id as varchar) as url, cast(least(100,greatest(0, 40*l.quality - 20*l.toxic + cast((d.doc_id*37)%50 as int))) as int) as score,
case when l.quality=1 then """ + _of(P.POS_LABELS) + """ else '' end as pos_label, case when l.quality=0 then """ + _of(P.NEG_LABELS) + """ else '' end as neg_label, split_part(text, chr(10), 1) as summary from labels l join documents d using(doc_id))""",
    "games": """games as materialized (select date '2024-01-01' + cast(p_partkey%30 as int) as date, p_name||' '||cast(p_partkey as varchar) as game_name, p_type||'|'||p_brand as tags, p_type as genre,
case when p_size>=25 then cast(p_size-24 as varchar)||'万+预约' else cast(p_size*100 as varchar)||'预约' end as downloads, p_partkey%9=0 as is_port from part)""",
    "audit_log": """audit_log as materialized (select cast(conv_id as varchar) as run_id, cast(turn as int) as round_num, role as tool_name, cast(length(text) as int) as latency_ms, turn%2=1 as cache_hit from conversations)""",
}


def sql(body: str, *names: str) -> str:
    """An oracle: the named tables' definitions before a body that begins with a select or further definitions."""
    body = body.strip()
    further = not body.lower().startswith("select")
    return "with recursive " + ",\n".join(SQL[n] for n in names) + (",\n" if further else "\n") + body
