"""The same results in plain SQL, written from the definitions and not from the jobs."""

from __future__ import annotations

from checks import model_sql
from checks.queries import COEFFICIENTS, DIGITS, RULES, SEASON, TEAM, WEEKS
from checks.views import with_views

# Stated once more, not taken from the jobs, so that a wrong value there shows.
EPSILON, LOGIT_LIMIT, INTERCEPT = 2.220446049250313e-16, 30.0, "(Intercept)"
WEEK_RATES = (
    "epa_per_play", "sr", "dropback_epa", "dropback_sr", "dropback_explosive", "rush_epa", "rush_sr", "rush_explosive",
)
MEASURES = (
    "tot_plays", "tot_yds", "epa_per_play", "sr", "passes", "passing_yds", "dropback_epa", "dropback_sr",
    "dropback_explosive", "rushes", "rushing_yds", "rush_epa", "rush_sr", "rush_explosive",
)
RACE_COLUMNS = (
    "player_display_name", "mvp_prob", "pred_mvp", "tds_rank", "yds_rank", "win_rank", "epa_rank", "total_interceptions",
)
WEEK_TABLE = (
    "week", "opp_logo", "result", "final_score", "spread_line", "team_rest", "opponent_rest", "passes",
    "passing_yds", "interceptions", "dropback_epa", "dropback_epa_rank", "dropback_sr", "dropback_sr_rank",
    "dropback_explosive", "dropback_explosive_rank", "rushes", "rushing_yds", "lost_fumbles", "rush_epa",
    "rush_epa_rank", "rush_sr", "rush_explosive", "rush_explosive_rank", "rush_sr_rank", "tot_plays", "tot_yds",
    "tot_tos", "epa_per_play", "epa_per_play_rank", "sr", "sr_rank",
)
FLAGS = ("is_no_huddle", "is_catchable_ball", "is_contested_ball", "is_created_reception", "is_drop")
CHARTED = f"""select p.*, {", ".join("c." + f for f in FLAGS)}
from fx_plays p join fx_charting c on p.game_id = c.nflverse_game_id and p.play_id = c.nflverse_play_id"""
PLAY = "epa is not null and (pass = 1 or rush = 1)"
TARGET = (
    "epa is not null and posteam is not null and pass = 1 and two_point_attempt <> 1 "
    "and play_type <> 'no_play' and receiver_player_id is not null"
)
STANDINGS = """select season, case when team = 'OAK' then 'T03' else team end as team, wins, losses, ties
from fx_standings"""
SIDES = {
    "offense": ("posteam", "defteam", "desc", "team_score"),
    "defense": ("defteam", "posteam", "asc", "opponent_score"),
}


def strict(x: str, kind: str = "bigint") -> str:
    return f"cast(case when count({x}) = count(*) then sum({x}) end as {kind})"


def lenient(x: str, kind: str = "bigint") -> str:
    return f"cast(coalesce(sum({x}), 0) as {kind})"


def over(n: str, d: str) -> str:
    return f"cast({n} as double) / nullif(cast({d} as double), 0)"


def r(x: str) -> str:
    # The same machine operations as in Spark, so that a tie at the last digit falls alike.
    return f"floor(({x}) * 1e{DIGITS} + 0.5e0) / 1e{DIGITS}"


def week_range(weeks) -> str:
    return "true" if weeks is None else f"week between {weeks[0]} and {weeks[1]}"


# explosive flags, unknown when their condition is unknown
def explosive(kind: str, yards: int) -> str:
    both = f"({kind} = 1 and yards_gained >= {yards})"
    return f"case when {both} then 1 when not {both} then 0 end"


X_PASS, X_RUN = explosive("pass", 20), explosive("rush", 10)

WEEK_MEASURES = {
    "epa_per_play": over(strict("epa", "double"), "count(*)"),
    "passes": strict("pass"),
    "interceptions": lenient("interception"),
    "passing_yds": lenient("passing_yards", "double"),
    "dropback_epa": over(strict("epa * pass", "double"), strict("pass")),
    "dropback_sr": over(strict("success * pass"), strict("pass")),
    "dropback_explosive": over(lenient(X_PASS), strict("pass")),
    "rushes": strict("rush"),
    "lost_fumbles": lenient("fumble_lost"),
    "rushing_yds": lenient("rushing_yards", "double"),
    "rush_epa": over(strict("epa * rush", "double"), strict("rush")),
    "rush_sr": over(strict("success * rush"), strict("rush")),
    "rush_explosive": over(lenient(X_RUN), strict("rush")),
    "sr": over(strict("success"), "count(*)"),
    "tot_plays": f"{strict('pass')} + {strict('rush')}",
    "tot_yds": f"{lenient('passing_yards', 'double')} + {lenient('rushing_yards', 'double')}",
    "tot_tos": f"{lenient('interception')} + {lenient('fumble_lost')}",
}
RATES = set(WEEK_RATES)


def aliased(measures: dict[str, str], do_round: bool = False) -> str:
    return ",\n  ".join(f"{r(e) if do_round and n in RATES else e} as {n}" for n, e in measures.items())


def week_stats(side: str) -> str:
    team, opponent, _, _ = SIDES[side]
    return f"""select season, week, season_type, {team} as team, {opponent} as opponent, '{side}' as type,
  {aliased(WEEK_MEASURES)}
from ({CHARTED}) where {PLAY} and {team} is not null
group by season, week, season_type, {team}, {opponent}"""


STAT_COLUMNS = ["season", "week", "season_type", "team", "opponent", "type", *WEEK_MEASURES]


def shown(columns, rates=RATES, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + c)} as {c}" if c in rates else f"{prefix}{c}" for c in columns)


def ranked(columns, partition: str, direction: str, prefix: str = "") -> str:
    return ",\n  ".join(
        f"case when {prefix}{c} is not null then cast(rank() over (partition by {partition} "
        f"order by {prefix}{c} {direction} nulls last) as integer) end as {c}_rank"
        for c in columns
    )


def week_ranks(side: str) -> str:
    direction = SIDES[side][2]
    return f"""with s as ({week_stats(side)})
select {shown(STAT_COLUMNS)},
  {ranked(WEEK_RATES, "season, week", direction)} from s"""


TEAM_ROWS = """select season, week, spread_line, home_team as team, home_score as team_score, home_rest as team_rest,
  away_team as opponent, away_score as opponent_score, away_rest as opponent_rest from fx_schedules
union all
select season, week, {away}spread_line, away_team, away_score, away_rest, home_team, home_score, home_rest
from fx_schedules"""
GAMES = TEAM_ROWS.format(away="")
RESULT = """case when team_score < opponent_score then 'L' when team_score > opponent_score then 'W'
  when team_score = opponent_score then 'T' end"""
SCORE = "coalesce(cast({p}team_score as varchar), 'NA') || '-' || coalesce(cast({p}opponent_score as varchar), 'NA')"


def week_report(side: str) -> str:
    direction = SIDES[side][2]
    return f"""with s as ({week_stats(side)}), g as (select *, {RESULT} as result from ({GAMES}))
select {shown(STAT_COLUMNS, prefix="s.")}, g.team_score, g.opponent_score, g.team_rest, g.opponent_rest,
  g.spread_line, g.result, o.team_logo_espn as opp_logo, w.team_wordmark as team_logo,
  {SCORE.format(p="g.")} as final_score,
  {ranked(WEEK_RATES, "s.season, s.week", direction, "s.")}
from s left join g on s.season = g.season and s.team = g.team and s.week = g.week
left join fx_teams o on s.opponent = o.team_abbr left join fx_teams w on s.team = w.team_abbr"""


def week_table(side: str) -> str:
    return f"""select {", ".join(WEEK_TABLE)} from ({week_report(side)})
where team = '{TEAM}' and season = {SEASON} and {week_range(WEEKS)}"""


EFF = {
    "total_epa": strict("epa", "double"),
    "total_plays": "count(*)",
    "total_success": strict("success"),
    "total_pass_epa": strict("epa * pass", "double"),
    "total_passes": strict("pass"),
    "total_pass_success": strict("success * pass"),
    "total_pass_explosive": lenient(X_PASS),
    "total_rush_epa": strict("epa * rush", "double"),
    "total_rushes": strict("rush"),
    "total_rush_success": strict("success * rush"),
    "total_rush_explosive": lenient(X_RUN),
}


def points(column: str) -> str:
    return f"select season, team, week, {strict(column)} as pts from ({GAMES}) group by season, team, week"


def eff_totals(side: str) -> str:
    team, _, _, score = SIDES[side]
    columns = ", ".join(f"s.{c}" for c in ["season", "week", "season_type", "team", "type", *EFF])
    return f"""select {columns}, p.pts, l.team_logo_espn as team_logo from (
select season, week, season_type, {team} as team, '{side}' as type,
  {aliased(EFF)}
from ({CHARTED}) where {PLAY} and {team} is not null group by season, week, season_type, {team}) s
left join ({points(score)}) p on s.season = p.season and s.team = p.team and s.week = p.week
left join fx_teams l on s.team = l.team_abbr"""


EFF_RATES = {
    "epa_per_play": ("total_epa", "total_plays"),
    "sr": ("total_success", "total_plays"),
    "dropback_epa": ("total_pass_epa", "total_passes"),
    "dropback_sr": ("total_pass_success", "total_passes"),
    "dropback_exp": ("total_pass_explosive", "total_passes"),
    "rush_epa": ("total_rush_epa", "total_rushes"),
    "rush_sr": ("total_rush_success", "total_rushes"),
    "rush_exp": ("total_rush_explosive", "total_rushes"),
}


def eff_summary(side: str, weeks=None, team: str | None = None) -> str:
    direction = SIDES[side][2]
    rates = ", ".join(f"{over(strict(n, 'double'), strict(d, 'double'))} as {c}" for c, (n, d) in EFF_RATES.items())
    columns = [*EFF_RATES, "pts"]
    keys = "season, team_logo" if team else "season, team, type, team_logo"
    where = f"where t.team = '{team}'" if team else ""
    return f"""with t as ({eff_totals(side)}),
e as (select season, team, type, team_logo, {rates}, {strict("pts")} as pts from t where {week_range(weeks)}
  group by season, team, type, team_logo),
k as (select *, {ranked(columns, "season, type", direction)} from e)
select {", ".join("t." + k.strip() for k in keys.split(","))}, {shown(columns, set(EFF_RATES), "t.")},
  {", ".join(f"t.{c}_rank" for c in columns)}, w.wins, w.losses, w.ties
from k t left join ({STANDINGS}) w on t.season = w.season and t.team = w.team {where}"""


CATCHABLE, CONTESTED = "cast(is_catchable_ball as integer)", "cast(is_contested_ball as integer)"
COUNTS = {
    "targets_pbp": "count(*)",
    "receptions_pbp": strict("complete_pass"),
    "catchable_contested": strict(f"{CATCHABLE} * {CONTESTED}"),
    "catchable_not_contested": strict(f"{CATCHABLE} * (1 - {CONTESTED})"),
    "not_catchable": strict(f"1 - {CATCHABLE}"),
    "created_receptions": strict("cast(is_created_reception as integer)"),
    "drops": strict("cast(is_drop as integer)"),
    "total_epa": strict("epa", "double"),
}
RECEIVER_QC = f"""select c.season, c.posteam, c.week, c.receiver_player_id, c.receiver_player_name,
  {", ".join("c." + n for n in COUNTS)},
  s.player_display_name, s.position, s.headshot_url, s.targets, s.receptions, s.receiving_epa,
  s.receiving_epa / nullif(c.targets_pbp, 0) as epa_per_target,
  c.targets_pbp - s.targets as targets_diff, c.receptions_pbp - s.receptions as receptions_diff,
  c.total_epa - s.receiving_epa as epa_diff
from (select season, posteam, week, receiver_player_id, receiver_player_name, {aliased(COUNTS)}
  from ({CHARTED}) where {TARGET} group by season, posteam, week, receiver_player_id, receiver_player_name) c
left join fx_player_stats s on c.receiver_player_id = s.player_id and c.season = s.season and c.week = s.week"""
QC_DOUBLES = {"total_epa", "receiving_epa", "epa_per_target", "epa_diff"}
RECEIVER_GAME_COLUMNS = (
    "receiver_player_id player_display_name position headshot_url season posteam week targets_pbp targets targets_diff "
    "receptions_pbp receptions receptions_diff drops catchable_contested catchable_not_contested not_catchable "
    "created_receptions total_epa receiving_epa epa_per_target epa_diff"
).split()
RECEIVER_GAME = f"select * exclude (receiver_player_name) from ({RECEIVER_QC}) where position in ('WR', 'TE', 'RB')"


def receiver_breakdown(keys: str, where: str) -> str:
    sums = "targets receptions catchable_contested catchable_not_contested not_catchable created_receptions drops"
    totals = ", ".join(f"{strict(c)} as {c}" for c in sums.split())
    return f"""select {keys}, targets, receptions, catchable_contested, catchable_not_contested, not_catchable,
  {r(over("not_catchable", "targets"))} as not_catchable_rate, created_receptions, drops, {r("total_epa")} as total_epa,
  {r(over("total_epa", "targets"))} as epa_per_target
from (select season, posteam, headshot_url, player_display_name, position, {totals},
    {strict("receiving_epa", "double")} as total_epa
  from ({RECEIVER_GAME}) where {where}
  group by season, posteam, headshot_url, player_display_name, position)"""


def pivot(keys: str, weeks=None, where: str = "true", drop_team: bool = False, season: int | None = None) -> str:
    def rate(name: str) -> str:
        # no plays of the kind: 0, unless the total itself is unknown
        return r(f"case when {name}_n = 0 and {name}_d = 0 then 0.0e0 else {over(name + '_n', name + '_d')} end")

    parts = {
        "epa_per_play": (strict("epa", "double"), "count(*)"),
        "sr": (strict("success"), "count(*)"),
        "dropback_epa": (strict("epa * pass", "double"), strict("pass")),
        "dropback_sr": (strict("success * pass"), strict("pass")),
        "dropback_explosive": (lenient(X_PASS), strict("pass")),
        "rush_epa": (strict("epa * rush", "double"), strict("rush")),
        "rush_sr": (strict("success * rush"), strict("rush")),
        "rush_explosive": (lenient(X_RUN), strict("rush")),
    }
    pieces = ", ".join(f"{n} as {c}_n, {d} as {c}_d" for c, (n, d) in parts.items())
    counts = ", ".join(f"{WEEK_MEASURES[c]} as {c}" for c in MEASURES if c not in parts)
    measures = ", ".join(f"{rate(c)} as {c}" if c in parts else c for c in MEASURES)
    out = keys if drop_team else f"posteam, {keys}"
    return f"""select {out}, {measures} from (select posteam, {keys}, {counts}, {pieces} from ({CHARTED})
  where {PLAY} and posteam is not null and offense_formation is not null and {week_range(weeks)} and {"true" if season is None else f"season = {season}"}
  group by posteam, {keys}) where {where}"""


QB_SEASON = f"""select season, recent_team as team, player_display_name, player_id,
  {lenient("completions")} as total_cmp, {lenient("attempts")} as total_attempts,
  {lenient("passing_yards + rushing_yards")} as total_yards, {lenient("passing_tds + rushing_tds")} as total_tds,
  {lenient("interceptions")} as total_interceptions, avg(passing_epa) as mean_epa
from fx_player_stats where season_type = 'REG' and position = 'QB' and season >= {RULES.first_season} and season not in (1996)
group by season, recent_team, player_display_name, player_id
having coalesce(sum(attempts), 0) >= {RULES.min_attempts}"""


def ordinal(column: str, direction: str, name: str) -> str:
    return f"""cast(row_number() over (partition by season order by {column} {direction} nulls last,
    team nulls last, player_display_name nulls last, player_id nulls last) as integer) as {name}"""


QB_RANKS = f"""select season, player_display_name, player_id, {ordinal("total_cmp", "desc", "cmp_rank")},
  {ordinal("total_attempts", "desc", "att_rank")}, {ordinal("total_yards", "desc", "yds_rank")},
  {ordinal("total_tds", "desc", "tds_rank")}, {ordinal("total_interceptions", "asc", "int_rank")},
  {ordinal("mean_epa", "desc", "epa_rank")}, team, total_interceptions from ({QB_SEASON})"""
QB_WIN_RANK = f"""select q.*, w.wins, case when w.wins is not null then
    rank() over (partition by q.season order by w.wins desc nulls last)
    + (count(*) over (partition by q.season, w.wins) - 1) / 2.0e0 end as win_rank
from ({QB_RANKS}) q left join ({STANDINGS}) w on q.season = w.season and q.team = w.team"""
WINNERS = f"""select "Player" as player_display_name, "Pos" as position, 1.0e0 as mvp, "Year" as season
from fx_mvps where "Year" >= {RULES.first_season}"""
LABELLED = f"""select q.season, q.player_display_name, q.player_id, q.team, q.cmp_rank, q.att_rank, q.yds_rank,
  q.tds_rank, q.int_rank, q.epa_rank, q.total_interceptions, q.wins, q.win_rank, coalesce(m.mvp, 0.0e0) as mvp
from ({QB_WIN_RANK}) q left join ({WINNERS}) m
  on q.season = m.season and q.player_display_name = m.player_display_name"""
MODEL_CELLS = "cmp_rank att_rank yds_rank tds_rank int_rank epa_rank total_interceptions wins win_rank mvp".split()


def _scored() -> str:
    eta = " + ".join(
        f"({b!r}e0)" if t == INTERCEPT else f"({b!r}e0) * {t}" for t, b in ((t, float(b)) for t, b in COEFFICIENTS.items())
    )
    eta = f"cast({eta} as double)"
    odds = f"case when eta < -{LOGIT_LIMIT} then {EPSILON!r} when eta > {LOGIT_LIMIT} then {1 / EPSILON!r} else exp(eta) end"
    return f"""select *, cast(pred = max(pred) over (partition by season) as double) as pred_mvp,
  case when count(pred) over (partition by season) = count(*) over (partition by season)
    then pred / nullif(sum(pred) over (partition by season), 0) end as mvp_prob
from (select *, odds / (1.0e0 + odds) as pred from (select *, {odds} as odds from (select *, {eta} as eta from ({LABELLED}))))"""


SCORED = _scored()
CONFUSION = f"""select pred_mvp, mvp, count(*) as n from ({SCORED})
where pred_mvp is not null and mvp is not null group by pred_mvp, mvp"""


def _metrics(scored: str) -> str:
    def one(metric: str, expression: str) -> str:
        return f"select '{metric}' as metric, {r(expression)} as estimate from c"

    sens, spec = "(tp / nullif(tp + fn, 0))", "(tn / nullif(tn + fp, 0))"
    prec, agreed = "(tp / nullif(tp + fp, 0))", "((tp + tn) / n)"
    chance = "(((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n))"
    rows = [
        one("accuracy", agreed),
        one("kap", f"({agreed} - {chance}) / nullif(1 - {chance}, 0)"),
        one("sens", sens),
        one("spec", spec),
        one("ppv", prec),
        one("npv", "tn / nullif(tn + fn, 0)"),
        one("mcc", "(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)"),
        one("j_index", f"{sens} + {spec} - 1"),
        one("bal_accuracy", f"({sens} + {spec}) / 2"),
        one("detection_prevalence", "(tp + fp) / n"),
        one("precision", prec),
        one("recall", sens),
        one("f_meas", f"2 * {prec} * {sens} / nullif({prec} + {sens}, 0)"),
    ]
    return f"""with s as ({scored}), c as (select
  cast(count(*) filter (pred_mvp = 1 and mvp = 1) as double) as tp, cast(count(*) filter (pred_mvp = 1 and mvp = 0) as double) as fp,
  cast(count(*) filter (pred_mvp = 0 and mvp = 1) as double) as fn, cast(count(*) filter (pred_mvp = 0 and mvp = 0) as double) as tn,
  cast(count(*) filter (pred_mvp is not null and mvp is not null) as double) as n from s)
{" union all ".join(rows)}"""


MISSES = f"""select season, player_display_name, team, player_id,
  case when mvp = 1 then 'Actual MVP' else 'Predicted MVP' end as outcome
from ({SCORED}) where (mvp = 1 and pred_mvp = 0) or (mvp = 0 and pred_mvp = 1)"""
RACE_ORDER = "mvp_prob desc nulls last, player_display_name nulls last, team nulls last, player_id nulls last"
RACE = shown(RACE_COLUMNS, {"mvp_prob", "win_rank"})


TRAIN = f"season between {RULES.first_season} and {RULES.train_last_season} and season not in (1998)"
TEST = f"season >= {RULES.test_first_season}"
COMPLETE = "mvp is not null and tds_rank is not null and yds_rank is not null and win_rank is not null and epa_rank is not null and total_interceptions is not null"
NULL_FIT = f"""select n as "rows", n - 1 as null_df, n - 6 as residual_df,
  {r("-2.0e0 * (ones * ln(ones / n) + (n - ones) * ln(1.0e0 - ones / n))")} as null_deviance
from (select count(*) as n, cast(sum(mvp) as double) as ones from ({LABELLED}) where {TRAIN} and {COMPLETE})"""
SHARES = f"""select season, case when count(*) = count(*) filter ({COMPLETE}) then 1.0e0 end as share,
  case when count(*) filter ({COMPLETE}) > 0 then true end as has_favourite from ({LABELLED}) where ({TRAIN}) or ({TEST}) group by season"""


FITTED_ON = f"{TRAIN} and {COMPLETE}"
STORED_SEASONS = "between 1996 and 1998"


def fitted(chosen: str) -> str:
    return model_sql.scored(LABELLED, FITTED_ON, chosen)


def frequencies(column: str, where: str = "true") -> str:
    return f"""select {column}, count(*) as n from ({LABELLED}) where {column} is not null and {where} group by {column}"""


def _texts() -> dict[str, str]:
    plays = f"select * from ({CHARTED}) where {PLAY}"
    week_rows = week_stats("offense")
    rounded_stats = {s: f"select {shown(STAT_COLUMNS)} from ({week_stats(s)})" for s in SIDES}
    return {
        "plays_charted": CHARTED,
        "valid_plays": f"{plays} and posteam is not null",
        "valid_defense_plays": f"{plays} and defteam is not null",
        "valid_targets": f"select * from ({CHARTED}) where {TARGET}",
        "explosive_plays": f"""select game_id, play_id, {X_PASS} as explosive_pass, {X_RUN} as explosive_run
from ({CHARTED}) where {PLAY} and posteam is not null""",
        "schedule_team_rows": GAMES,
        "schedule_team_rows_inverted": TEAM_ROWS.format(away="-"),
        "game_results": f"select *, {RESULT} as result, {SCORE.format(p='')} as final_score from ({GAMES})",
        "season_results": GAMES,
        "standings_relabelled": STANDINGS,
        "season_standing": f"select * from ({STANDINGS}) where season = {SEASON}",
        "team_week_points": points("team_score"),
        "team_week_points_allowed": points("opponent_score"),
        "team_choices": "select team_abbr from fx_teams where team_abbr not in ('T05', 'T17') or team_abbr is null",
        "off_week_stats": rounded_stats["offense"],
        "def_week_stats": rounded_stats["defense"],
        "off_week_ranks": week_ranks("offense"),
        "def_week_ranks": week_ranks("defense"),
        "all_week_ranks": f"select * from ({week_ranks('offense')}) union all select * from ({week_ranks('defense')})",
        "off_week_report": week_report("offense"),
        "def_week_report": week_report("defense"),
        "off_week_table": week_table("offense"),
        "def_week_table": week_table("defense"),
        "week_bounds": f"select min(week) as first_week, max(week) as last_week from ({week_rows})",
        "week_choices": f"select distinct week from ({week_rows})",
        "off_eff_totals": eff_totals("offense"),
        "def_eff_totals": eff_totals("defense"),
        "off_eff_summary": eff_summary("offense"),
        "def_eff_summary": eff_summary("defense"),
        "off_eff_summary_weeks": eff_summary("offense", WEEKS),
        "def_eff_summary_weeks": eff_summary("defense", WEEKS),
        "off_eff_team": eff_summary("offense", WEEKS, TEAM),
        "def_eff_team": eff_summary("defense", WEEKS, TEAM),
        "receiver_qc": f"select * replace ({', '.join(f'{r(c)} as {c}' for c in sorted(QC_DOUBLES))}) from ({RECEIVER_QC})",
        "receiver_game": f"select {shown(RECEIVER_GAME_COLUMNS, QC_DOUBLES)} from ({RECEIVER_GAME})",
        "receiver_breakdown": receiver_breakdown("season, posteam, headshot_url, player_display_name, position", "true"),
        "receiver_table": receiver_breakdown(
            "headshot_url, player_display_name, position",
            f"posteam = '{TEAM}' and season = {SEASON} and {week_range(WEEKS)}",
        ),
        "pivot_personnel": pivot("offense_personnel"),
        "pivot_two_dims": pivot("offense_formation, offense_personnel", WEEKS),
        "pivot_charting_dim": pivot("season, is_no_huddle"),
        "pivot_team": pivot("offense_personnel", WEEKS, f"posteam = '{TEAM}'", drop_team=True, season=SEASON),
        "pivot_team_week": "select * exclude (week) from ("
        + pivot("week, offense_personnel", (4, 4), f"posteam = '{TEAM}'", drop_team=True, season=SEASON)
        + ")",
        "qb_season": f"select * replace ({r('mean_epa')} as mean_epa) from ({QB_SEASON})",
        "qb_ranks": QB_RANKS,
        "qb_win_rank": QB_WIN_RANK,
        "award_winners": WINNERS,
        "qb_labelled": LABELLED,
        "missing_cells": f"""select cast(sum({" + ".join(f"cast({c} is null as integer)" for c in MODEL_CELLS)}) * count(*)
as bigint) as num_missing from ({LABELLED})""",
        "class_counts": frequencies("mvp"),
        "train_seasons": frequencies("season", TRAIN),
        "test_seasons": frequencies("season", TEST),
        "season_prob": f"""select season, team, player_display_name, player_id, mvp, {r("pred")} as pred, pred_mvp,
  {r("mvp_prob")} as mvp_prob from ({SCORED})""",
        "confusion": CONFUSION,
        "binary_metrics": _metrics(SCORED),
        "misses": f"select season, player_display_name, outcome from ({MISSES})",
        "missed_seasons": f"""select season,
  max(case when outcome = 'Actual MVP' then player_display_name end) as "Actual MVP",
  max(case when outcome = 'Predicted MVP' then player_display_name end) as "Predicted MVP"
from (select *, row_number() over (partition by season, outcome
    order by player_display_name nulls last, team nulls last, player_id nulls last) as place from ({MISSES}))
group by season, place""",
        "mvp_score_equations": "select unnest(['(Intercept)', 'tds_rank', 'yds_rank', 'win_rank', 'epa_rank', 'total_interceptions']) as term, 0.0e0 as score",
        "mvp_null_fit": NULL_FIT,
        "mvp_season_shares": SHARES,
        "mvp_coefficients": model_sql.coefficients(LABELLED, FITTED_ON, r),
        "mvp_fit": model_sql.fit_table(LABELLED, FITTED_ON, r),
        "mvp_model_scored": f"select * replace ({r('pred')} as pred, {r('mvp_prob')} as mvp_prob, {r('win_rank')} as win_rank) "
        f"from ({fitted(f'({TRAIN}) or ({TEST})')})",
        "mvp_test_metrics": _metrics(fitted(TEST)),
        "file_valid_plays": f"select * from fx_plays where {PLAY} and posteam is not null and season {STORED_SEASONS} and {week_range(WEEKS)}",
        "file_charting": f"select * from fx_charting where ftn_season {STORED_SEASONS}",
        "file_schedule_team_rows": f"select * from ({GAMES}) where season {STORED_SEASONS}",
        "file_player_stats": f"select * from fx_player_stats where season {STORED_SEASONS}",
        "file_team_choices": "select team_abbr from fx_teams where team_abbr not in ('T05', 'T17') or team_abbr is null",
        "file_off_week_report": f"select * from ({week_report('offense')}) where season {STORED_SEASONS}",
        "file_receiver_breakdown": receiver_breakdown(
            "season, posteam, headshot_url, player_display_name, position", f"season {STORED_SEASONS}"
        ),
        "file_qb_season": f"select * replace ({r('mean_epa')} as mean_epa) from ({QB_SEASON}) where season {STORED_SEASONS}",
        "kept_off_eff_summary": eff_summary("offense"),
        "kept_def_eff_summary": eff_summary("defense"),
        "plays_charted_bucketed": CHARTED,
        "mvp_race": f"select {RACE} from (select * from ({SCORED}) where season = {SEASON} order by {RACE_ORDER} limit 10)",
        "mvp_races": f"""select season, place, {RACE} from (select *, cast(row_number() over
  (partition by season order by {RACE_ORDER}) as integer) as place from ({SCORED})) where place <= 10""",
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in _texts().items()}
