"""Table schemas.

Ids are content hashes of the natural key (`entity_id`), because a serial
counter would need one writer.  The list of new entities of a log row is kept
in the child table `update_log_items`, so that a row never grows with a site.
"""

from pyspark.sql import types as T

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FEEDS = _struct(id=_S, url=_S, domain=_S, created_at=_TS, updated_at=_TS)
SNAPSHOTS = _struct(domain=_S, gen=_L, url_count=_L, updated_at=_TS)
SNAPSHOT_URLS = _struct(domain=_S, pos=_L, url=_S)
GAMES = _struct(
    id=_S, name=_S, clean_name=_S, platform_count=_I, score=T.FloatType(), first_seen=_TS, updated_at=_TS
)
GAME_SOURCES = _struct(id=_S, game_id=_S, domain=_S, url=_S, first_seen=_TS)
UPDATE_LOGS = _struct(id=_S, domain=_S, feed_ord=_L, new_games_count=_L, checked_at=_TS)
UPDATE_LOG_ITEMS = _struct(
    log_id=_S, feed_ord=_L, pos=_L, name=_S, url=_S, is_cross=T.BooleanType(), platform_count=_L
)

TABLES = {
    "feeds": FEEDS,
    "snapshots": SNAPSHOTS,
    "snapshot_urls": SNAPSHOT_URLS,
    "games": GAMES,
    "game_sources": GAME_SOURCES,
    "update_logs": UPDATE_LOGS,
    "update_log_items": UPDATE_LOG_ITEMS,
}
