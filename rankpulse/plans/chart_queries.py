"""Charts and stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import charts, stories
from . import query

WORDS = ("gear", "PROMO")

CHANGES = """dt as (select date as date, lag(date) over (order by date) as prev_date from (select distinct date from rankings)),
today as (select r.* from rankings r join dt using (date) where prev_date is not null),
ch as (select distinct date, platform, chart_type from today),
bef as (select dt.date, r.platform, r.chart_type, r.bundle_id, r.rank, r.game_name, r.developer, r.category from rankings r join dt on dt.prev_date = r.date join ch on ch.date = dt.date and ch.platform = r.platform and ch.chart_type = r.chart_type),
d0 as (select coalesce(t.date,y.date) date, coalesce(t.platform,y.platform) platform, coalesce(t.chart_type,y.chart_type) chart_type, coalesce(t.bundle_id,y.bundle_id) bundle_id,
 case when t.bundle_id is not null then t.game_name else y.game_name end game_name, case when t.bundle_id is not null then t.developer else y.developer end developer,
 case when t.bundle_id is not null then t.category else y.category end category, t.rank today_rank, y.rank yesterday_rank, y.rank - t.rank rank_change,
 case when y.rank is null then 'new_entry' when t.rank is null then 'dropped_out' when y.rank > t.rank then 'up' when y.rank < t.rank then 'down' else 'stable' end change_type
 from today t full join bef y on t.date=y.date and t.platform=y.platform and t.chart_type=y.chart_type and t.bundle_id=y.bundle_id),
d1 as (select *, coalesce(today_rank,yesterday_rank) r, coalesce(nullif(yesterday_rank,0),99) b, abs(coalesce(rank_change,0)) dl,
 regexp_matches(lower(concat_ws(' ',game_name,category,developer)), '(^|[^a-z0-9_])(gear|promo)([^a-z0-9_]|$)') tr from d0),
d2 as (select *, least(100, case when r<=3 then 50 when r<=5 then 35 when r<=10 then 20 when r<=30 then 10 when r<=50 then 5 else 2 end
 + case change_type when 'new_entry' then case when r<=10 then 50 when r<=50 then 35 else 20 end when 'dropped_out' then case when b<=10 then 40 when b<=30 then 20 else 5 end
   when 'stable' then 0 else case when r<=5 and dl>=1 then 15 when r<=10 and dl>=3 then 10 else 0 end + case when dl>=20 then 35 when dl>=10 then 20 when dl>=5 then 10 else 3 end
   + case when change_type='up' then case when b>30 and dl>=10 then 20 else 0 end + case when b>50 and dl>=5 then 10 else 0 end else 0 end end
 + case when tr and change_type<>'dropped_out' then 15 else 0 end) tenths from d1),
changes as materialized (select date,platform,chart_type,bundle_id,game_name,developer,category,today_rank,yesterday_rank,rank_change,change_type, cast(tenths/10.0 as decimal(4,1)) attention_score,
 tenths>=50 or (change_type in ('new_entry','dropped_out') and coalesce(today_rank,999)<=50) or (change_type in ('up','down') and coalesce(today_rank,999)<=5) is_significant from d2)"""

OVERVIEW = """ov as (select date, platform, chart_type, count(*) filter (change_type<>'dropped_out') total, count(*) filter (change_type='up') up, count(*) filter (change_type='down') down,
 count(*) filter (change_type='new_entry') new_entry, count(*) filter (change_type='dropped_out') dropped_out, count(*) filter (change_type='stable') stable,
 count(*) filter (abs(coalesce(rank_change,0))>=15 or (change_type='dropped_out' and yesterday_rank<=30)) big_moves from changes group by grouping sets ((date,platform,chart_type),(date)))"""
CLASS = "case when total=0 then 'quiet' when (up+down+new_entry+dropped_out)*10<=total and new_entry+dropped_out<=2 and big_moves=0 then 'quiet' when (up+down+new_entry+dropped_out)*10>=total*3 or new_entry+dropped_out>=8 or big_moves>=5 then 'volatile' else 'normal' end"
DAYS = f"""dc as (select date, {CLASS} day_class, total, up, down, new_entry, dropped_out, big_moves from ov where platform is null),
days2 as (select dt.date, case when prev_date is null then 'first_day' else coalesce(day_class,'quiet') end day_class, total, up, down, new_entry, dropped_out, big_moves from dt left join dc using (date))"""
STREAK = """s0 as (select *, lag(rank) over (partition by platform,chart_type,bundle_id order by date) pr from rankings where rank>=1),
s1 as (select *, sum(case when rank<pr then 0 else 1 end) over (partition by platform,chart_type,bundle_id order by date) isl from s0),
s2 as (select date,platform,chart_type,bundle_id,game_name, first_value(rank) over w start_rank, rank end_rank, cast(count(*) over w as int) streak from s1
 window w as (partition by platform,chart_type,bundle_id,isl order by date rows between 29 preceding and current row)),
streak as (select * from s2 where streak>=5)"""
STORIES = """b1 as (select date,'big_jump' story_type,platform,chart_type,bundle_id, game_name||' +'||rank_change headline, attention_score from changes where change_type='up' and rank_change>=15),
b2 as (select date,'black_horse',platform,chart_type,bundle_id, game_name||' #'||today_rank, attention_score from changes where change_type='new_entry' and today_rank<=50),
b3 as (select date,'cliff_drop',platform,chart_type,bundle_id, game_name||' -'||coalesce(cast(-rank_change as varchar),'out'), attention_score from changes where (change_type='down' and rank_change<=-20) or (change_type='dropped_out' and yesterday_rank<=30)),
b4 as (select c.date,'steady_climber',c.platform,c.chart_type,c.bundle_id, c.game_name||' '||streak||'d from #'||start_rank, attention_score from changes c join streak s on c.date=s.date and c.platform=s.platform and c.chart_type=s.chart_type and c.bundle_id=s.bundle_id where change_type='up'),
cl as (select date, 'category: '||category||' '||change_type||' '||count(distinct bundle_id) headline from changes where change_type in ('up','down') and category is not null and category not in ('','unknown') group by date,category,change_type having count(distinct bundle_id)>=3
 union all select date, 'developer: '||developer||' '||change_type||' '||count(distinct bundle_id) from changes where change_type in ('up','down') and developer is not null and developer not in ('','unknown') group by date,developer,change_type having count(distinct bundle_id)>=3),
st as (select * from b1 union all select * from b2 union all select * from b3 union all select * from b4 union all select date,'cluster_move','','','',headline,cast(0 as decimal(4,1)) from cl),
sp as (select *, cast(case story_type when 'big_jump' then 100 when 'black_horse' then 95 when 'cliff_drop' then 90 when 'steady_climber' then 80 else 70 end + attention_score/10.0 as decimal(6,2)) priority from st),
sd as (select * from (select *, row_number() over (partition by date,story_type, case when bundle_id<>'' then bundle_id else headline end order by priority desc, platform, chart_type, bundle_id, headline) n from sp) where n=1)"""


def _changes(spark, sf):
    return charts.diff(X.rankings(spark, sf), WORDS)


def _sql(*parts: str) -> str:
    return X.sql(",\n".join(parts[:-1]) + "\n" + parts[-1], "rankings")


@query(_sql(CHANGES, "select * from changes"), "attention_score")
def c1_chart_diff(spark, sf):
    return _changes(spark, sf)


@query(_sql(CHANGES, "select date, prev_date from dt"))
def c2_prev_date(spark, sf):
    return charts.prev_date(X.rankings(spark, sf))


@query(_sql(CHANGES, "select date, platform, chart_type, bundle_id, attention_score from d2 join changes using (date, platform, chart_type, bundle_id)"), "attention_score")
def s12_attention(spark, sf):
    return _changes(spark, sf).select("date", *charts.KEY, "attention_score")


@query(_sql(CHANGES, "select date, platform, chart_type, bundle_id from changes where is_significant"))
def b14_significant(spark, sf):
    return _changes(spark, sf).where("is_significant").select("date", *charts.KEY)


@query(_sql(CHANGES, "select date, change_type, count(*) as n, sum(attention_score) as attention from changes group by all"), "attention")
def g1_diff_all_dates(spark, sf):
    return _changes(spark, sf).groupBy("date", "change_type").agg(F.count(F.lit(1)).alias("n"), F.sum("attention_score").alias("attention"))


@query(_sql(CHANGES, "select c.date, c.platform, c.chart_type, c.bundle_id, coalesce(t.category, y.category, '') as category from changes c left join rankings t using (date, platform, chart_type, bundle_id) left join dt on dt.date = c.date left join rankings y on y.date = dt.prev_date and y.platform = c.platform and y.chart_type = c.chart_type and y.bundle_id = c.bundle_id"))
def c14_with_category(spark, sf):
    r = X.rankings(spark, sf)
    return charts.with_category(charts.diff_snapshots(r), r).select("date", *charts.KEY, "category")


@query(_sql(CHANGES, OVERVIEW, "select * from ov"))
def d1_chart_overview(spark, sf):
    return charts.overview(charts.diff_snapshots(X.rankings(spark, sf)))


@query(_sql(CHANGES, OVERVIEW, DAYS, "select * from days2"))
def d2_day_class(spark, sf):
    return charts.classify_days(X.rankings(spark, sf))


@query(_sql(CHANGES, f"r0 as (select date, count(*) filter (change_type<>'dropped_out') total, count(*) filter (change_type='up') up, count(*) filter (change_type='down') down, count(*) filter (change_type='new_entry') new_entry, count(*) filter (change_type='dropped_out') dropped_out, count(*) filter (abs(coalesce(rank_change,0))>=15) big_moves from changes group by date)", f"select *, {CLASS} as day_class from r0"))
def d3_day_class_report(spark, sf):
    return charts.classify_day_report(charts.diff_snapshots(X.rankings(spark, sf)))


@query(X.sql("select platform, chart_type, min(date) as first_date, max(date) as last_date, count(distinct date) as n_dates from rankings group by all", "rankings"))
def d8_available_charts(spark, sf):
    return charts.available_charts(X.rankings(spark, sf))


@query(X.sql("select distinct date from rankings", "rankings"))
def d8_available_dates(spark, sf):
    return charts.available_dates(X.rankings(spark, sf))


@query(X.sql("select platform, chart_type, bundle_id, date, rank, cast(row_number() over (partition by platform, chart_type, bundle_id order by date) as int) as seq from (select *, row_number() over (partition by platform, chart_type, bundle_id order by date desc) as k from rankings) where k <= 10", "rankings"))
def e1_history(spark, sf):
    return charts.history(X.rankings(spark, sf), 10)


@query(_sql(STREAK, "select * from streak"))
def e2_rising_streak(spark, sf):
    return charts.rising_streak(X.rankings(spark, sf))


def _detector(sql_name: str, names: str = "date, story_type, platform, chart_type, bundle_id, headline, attention_score"):
    return _sql(CHANGES, STREAK, STORIES, f"select {names} from (select * from st) where story_type = '{sql_name}'")


@query(_detector("big_jump"), "attention_score")
def e3_big_jumps(spark, sf):
    return stories.detect_big_jumps(_changes(spark, sf))


@query(_detector("black_horse"), "attention_score")
def e4_black_horses(spark, sf):
    return stories.detect_black_horses(_changes(spark, sf))


@query(_detector("cliff_drop"), "attention_score")
def e5_cliff_drops(spark, sf):
    return stories.detect_cliff_drops(_changes(spark, sf))


@query(_detector("cluster_move"), "attention_score")
def e6_cluster_moves(spark, sf):
    return stories.detect_cluster_moves(_changes(spark, sf))


@query(_sql(CHANGES, STREAK, STORIES, "select date, story_type, platform, chart_type, bundle_id, headline, attention_score, priority from sd"), "attention_score", "priority")
def e7_dedup_stories(spark, sf):
    c = _changes(spark, sf)
    found = stories.detect_big_jumps(c)
    for f in (stories.detect_black_horses(c), stories.detect_cliff_drops(c), stories.detect_steady_climbers(c, X.rankings(spark, sf)), stories.detect_cluster_moves(c)):
        found = found.unionByName(f)
    return stories.dedup_stories(stories.with_priority(found))


@query(_sql(CHANGES, STREAK, STORIES, "select date, story_type, platform, chart_type, bundle_id, headline, attention_score, priority, cast(k as int) as place from (select *, row_number() over (partition by date order by priority desc, story_type, platform, chart_type, bundle_id, headline) as k from sd) where k <= 8"), "attention_score", "priority")
def e8_pick_stories(spark, sf):
    return stories.pick_stories(_changes(spark, sf), X.rankings(spark, sf))


@query(_sql(CHANGES, STREAK, STORIES, "select date, story_type, count(*) as n from (select *, row_number() over (partition by date order by priority desc, story_type, platform, chart_type, bundle_id, headline) as k from sd) where k <= 8 group by all"))
def g2_story_mix(spark, sf):
    return stories.pick_stories(_changes(spark, sf), X.rankings(spark, sf)).groupBy("date", "story_type").agg(F.count(F.lit(1)).alias("n"))


@query(_sql(CHANGES, OVERVIEW, DAYS, "select days2.*, prev_date from days2 join dt using (date) where date = (select max(date) from rankings)"))
def e20_latest_summary(spark, sf):
    return charts.latest_summary(X.rankings(spark, sf))


@query(_sql(CHANGES, "x as (select date, platform, bundle_id, count(*) n_charts, min(today_rank) best_rank, max(today_rank) worst_rank, count(*) filter (rank_change>0) n_up, count(*) filter (rank_change<0) n_down from changes where today_rank is not null group by all having count(*)>=2)", "select *, case when n_up>0 and n_down>0 then 'divergence' when worst_rank-best_rank>=10 then 'leading' when n_up=n_charts then 'harvest' else 'none' end as signal from x"))
def x1_cross_chart(spark, sf):
    return charts.cross_chart(charts.diff_snapshots(X.rankings(spark, sf)))


def _role(name: str, chart: str) -> str:
    return f"min(today_rank) filter (chart_type = '{chart}') {name}_rank, max(rank_change) filter (chart_type = '{chart}') {name}_move"


@query(_sql(CHANGES, f"y as (select date, platform, bundle_id, {_role('free', 'view')}, {_role('grossing', 'purchase')}, {_role('hot', 'click')} from changes where today_rank is not null and chart_type in ('view', 'purchase', 'click') group by all having count(*) >= 2), z as (select *, coalesce(free_move >= 2, false) fu, coalesce(grossing_move >= 2, false) gu, coalesce(hot_move >= 2, false) hu, coalesce(free_move <= -2, false) or coalesce(grossing_move <= -2, false) or coalesce(hot_move <= -2, false) dn from y)", "select * exclude (fu, gu, hu, dn), case when (fu or gu or hu) and dn then 'divergence' when fu and gu and hu then 'leading' when fu and not gu and grossing_rank is not null then 'traffic_leak' when gu and not fu and free_rank is not null then 'harvest' when hu and not fu and free_rank is not null then 'word_of_mouth' else 'none' end as signal from z"))
def x1_cross_chart_signals(spark, sf):
    return charts.cross_chart_signals(charts.diff_snapshots(X.rankings(spark, sf)), "view", "purchase", "click", 2)


@query(_sql(CHANGES, OVERVIEW, DAYS, "select date, round(v, 4) as volatility, round(avg(v) over (order by date rows between 7 preceding and 1 preceding), 4) as week_mean from (select date, case when total>0 then (up+down+new_entry+dropped_out)::double/total end v from days2)"))
def x2_volatility(spark, sf):
    return charts.volatility(charts.classify_days(X.rankings(spark, sf)))
