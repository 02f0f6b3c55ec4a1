from snaplytics.sources.feeds import FEEDS, FeedFolder  # noqa: F401
from snaplytics.sources.readers import (  # noqa: F401
    conform,
    read_award_winners,
    read_charting,
    read_player_stats,
    read_plays,
    read_schedules,
    read_standings,
    read_team_logos,
    read_teams,
    season_standings,
)
from snaplytics.sources.sinks import bucket_count, replace_seasons, write_bucketed, write_results, write_text  # noqa: F401
