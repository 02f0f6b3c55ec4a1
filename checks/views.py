"""Sports tables derived from the given tables, as SQL both engines can run.

Every view grows with ``lineitem``. The text of a view is the same for Spark and for the
check engine, except for the schedule (see ``SPARK_ONLY``). Against the text in FIXTURES.md,
percentages are rounded by ``floor(x + 0.5)`` (much cheaper per row, same values) and the award
winners carry the redundant bound ``rn<=3`` (lets each task keep three rows per season).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("nation", "supplier", "part", "lineitem")

VIEWS: dict[str, str] = {
    "fx_base": """
select l.*, s.s_nationkey as tk, p.p_brand, p.p_size,
  cast(year(l_shipdate) as int) as season, cast(weekofyear(l_shipdate) as int) as week,
  cast(l_quantity as int) as q, cast(floor(l_discount*100+0.5e0) as int) as dc, cast(floor(l_tax*100+0.5e0) as int) as tx,
  concat('T', lpad(cast(s.s_nationkey as string),2,'0')) as tm,
  concat('P', lpad(cast(l_suppkey as string),6,'0')) as pid,
  concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_shipdate as date) as string)) as play_id,
  case when l_returnflag in ('A','N') then 1 else 0 end as pass,
  case when l_returnflag='R' and l_linestatus='F' then 1 else 0 end as rush
from lineitem l join supplier s on l_suppkey=s_suppkey join part p on l_partkey=p_partkey
""",
    "fx_plays": """
select concat(cast(season as string),'_',lpad(cast(week as string),2,'0'),'_',tm) as game_id, play_id,
  season, week, case when week<=40 then 'REG' else 'POST' end as season_type, tm as posteam,
  case when ((week-tk)%25+25)%25=tk then null else concat('T', lpad(cast(((week-tk)%25+25)%25 as string),2,'0')) end as defteam,
  pass, rush, case when q=13 then 'no_play' when pass=1 then 'pass' when rush=1 then 'run' else 'punt' end as play_type,
  case when q=7 then 1 else 0 end as two_point_attempt,
  case when tx=8 or (tx=7 and dc=2) then null else (dc-5)/8.0e0 end as epa,
  case when tx=8 or (dc=3 and tx=2 and q=3) then null when dc>5 then 1 else 0 end as success,
  cast(case when dc=10 then null else q-10 end as double) as yards_gained,
  cast(case when pass=1 and dc<>10 then q-10 end as double) as passing_yards,
  cast(case when rush=1 and dc<>10 then q-10 end as double) as rushing_yards,
  case when dc=10 then null when pass=1 and q=50 then 1 else 0 end as interception,
  case when q=49 then 1 else 0 end as fumble_lost,
  case when pass=1 and q%3<>0 then 1 else 0 end as complete_pass,
  case when pass=1 and l_linenumber<=6 then pid end as receiver_player_id,
  case when pass=1 and l_linenumber<=6 then concat('N.',pid) end as receiver_player_name,
  case when p_size<=10 then null when p_size<=30 then 'SHOTGUN' else 'UNDER CENTER' end as offense_formation,
  p_brand as offense_personnel
from fx_base
""",
    "fx_charting": """
select concat(cast(season as string),'_',lpad(cast(week as string),2,'0'),'_',tm) as nflverse_game_id, play_id as nflverse_play_id,
  season as ftn_season, q%2=0 as is_no_huddle,
  case when dc=9 and tx=1 then null else q%3<>0 or q%2=0 end as is_catchable_ball,
  q%5=0 as is_contested_ball, q%11=0 as is_created_reception, q%7=0 and q%3=0 as is_drop
from fx_base where p_size<>50
""",
    "fx_schedules": """
select w.season, w.week, concat('T', lpad(cast(i as string),2,'0')) as home_team, concat('T', lpad(cast(j as string),2,'0')) as away_team,
  case when w.week>=52 then null else (i*7+w.week*3+w.season)%45 end as home_score,
  case when w.week>=52 then null else (j*11+w.week*5+w.season)%45 end as away_score,
  6+i%3 as home_rest, 6+j%3 as away_rest, ((i-j)%14)/2.0e0 as spread_line
from (select season, week, n_nationkey as i, ((week-n_nationkey)%25+25)%25 as j from (select distinct season, week from fx_base) a cross join nation) w where i<j
""",
    "fx_player_stats": """
select season, week, case when week<=40 then 'REG' else 'POST' end as season_type, pid as player_id, concat('N.',pid) as player_name,
  concat('Name ',pid) as player_display_name, case l_suppkey%4 when 0 then 'QB' when 1 then 'WR' when 2 then 'TE' else 'RB' end as position,
  concat('http://img/',pid) as headshot_url, tm as recent_team,
  cast(sum(case when pass=1 and q%3<>0 then q%5 else 0 end) as int) as completions, cast(sum(case when pass=1 then q%5 else 0 end) as int) as attempts,
  cast(sum(case when pass=1 then q end) as int) as passing_yards, cast(sum(case when rush=1 then q-5 end) as int) as rushing_yards,
  cast(sum(case when pass=1 and q>=45 then 1 else 0 end) as int) as passing_tds, cast(sum(case when rush=1 and q>=48 then 1 else 0 end) as int) as rushing_tds,
  cast(sum(case when pass=1 and q=50 then 1 else 0 end) as int) as interceptions,
  sum(case when pass=1 then (dc-5)/8.0e0 end) as passing_epa,
  cast(sum(case when pass=1 and l_linenumber<=6 then 1 else 0 end) as int) as targets,
  cast(sum(case when pass=1 and l_linenumber<=6 and q%3<>0 then 1 else 0 end) as int) as receptions,
  sum(case when pass=1 and l_linenumber<=6 and tx<>8 then (dc-5)/8.0e0 end) as receiving_epa
from fx_base where not (l_suppkey%13=6 and week%4=1) group by season, week, pid, l_suppkey, tm
""",
    "fx_teams": """
select concat('T', lpad(cast(n_nationkey as string),2,'0')) as team_abbr, concat('http://logo/',n_name) as team_logo_espn, concat('http://wm/',n_name) as team_wordmark from nation where n_nationkey<>24
""",
    "fx_standings": """
select season, case when season<=1997 and team='T03' then 'OAK' else team end as team,
  cast(sum(case when a>b then 1 else 0 end) as int) as wins, cast(sum(case when a<b then 1 else 0 end) as int) as losses, cast(sum(case when a=b then 1 else 0 end) as int) as ties
from (select season, home_team as team, home_score as a, away_score as b from fx_schedules union all select season, away_team, away_score, home_score from fx_schedules) t where not (season=2001 and team in ('T09','T15')) group by season, team
""",
    "fx_mvps": """
select season as Year, player_display_name as Player, position as Pos from (
 select season, player_display_name, position, row_number() over (partition by season order by sum(passing_tds+rushing_tds) desc, player_display_name) as rn
 from fx_player_stats where position='QB' and season_type='REG' group by season, player_display_name, position) t where rn<=10 and rn=1+(season*3)%10
""",
}

# Reading turns NaN into NULL, so Spark gets NaN where the check engine has NULL from the start.
NAN_EPA = "case when tx=8 then null when tx=7 and dc=2 then cast('NaN' as double) else (dc-5)/8.0e0 end as epa,"
# The check engine pairs every week with every team by a product with the 25 nations. Spark
# gets the same rows by unfolding the range of nation keys on each week instead.
SPARK_ONLY = {
    "fx_plays": VIEWS["fx_plays"].replace("case when tx=8 or (tx=7 and dc=2) then null else (dc-5)/8.0e0 end as epa,", NAN_EPA),
    "fx_schedules": """
select w.season, w.week, concat('T', lpad(cast(i as string),2,'0')) as home_team, concat('T', lpad(cast(j as string),2,'0')) as away_team,
  case when w.week>=52 then null else (i*7+w.week*3+w.season)%45 end as home_score,
  case when w.week>=52 then null else (j*11+w.week*5+w.season)%45 end as away_score,
  6+i%3 as home_rest, 6+j%3 as away_rest, ((i-j)%14)/2.0e0 as spread_line
from (select season, week, i, ((week-i)%25+25)%25 as j from (select distinct season, week from fx_base) a
      lateral view explode((select array_agg(n_nationkey) from nation)) k as i) w where i<j
""",
}


def needed(text: str, known: dict[str, str]) -> list[str]:
    """Views that ``text`` uses, directly or through other views, in definition order."""
    used: set[str] = set()
    todo = [text]
    while todo:
        for name in set(re.findall(r"\bfx_\w+", todo.pop())) - used:
            used.add(name)
            todo.append(known[name])
    return [name for name in known if name in used]


def with_views(query: str) -> str:
    """``query`` for the check engine, with the views it uses as common table expressions."""
    parts = [f"{name} as ({VIEWS[name]})" for name in needed(query, VIEWS)]
    if not parts:
        return query
    text = query.strip()
    if text.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + text[15:]
    if text.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + text[5:]
    return "with " + ",\n".join(parts) + "\n" + text


class Derived:
    """The views over the parquet tables in one folder as lazy Spark tables, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = SPARK_ONLY.get(name, VIEWS[name])
        inputs = [n for n in (*BASE_TABLES, *VIEWS) if re.search(rf"\b{n}\b", text)]
        text = re.sub(rf"\b({'|'.join(inputs)})\b", r"{\1}", text)
        return self.spark.sql(text, **{n: self.table(n) for n in inputs})
