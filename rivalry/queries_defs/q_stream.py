"""ST1 query: refresh one season of the results table from two deliveries of
two files each, an old and a corrected one, in one batch and in one batch per file. Both tables must
equal the batch refresh (U3) with the corrected delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.catalog import query
from rivalry.oracle_views import with_views
from rivalry.queries_defs.q_ingest import REFRESH_SEASON
from rivalry.sources import files as SRC
from rivalry.sources import testdata as td
from rivalry.streaming.refresh import read_refreshed, stream_refresh

_SCHEMA = "match_id long, match_date date, home_team string, away_team string, fthg long, ftag long, ftr string, season string"


@query("st1_stream_refresh", with_views("select *, 'together' as arrival from matches union all select *, 'one by one' from matches", "matches"))
def st1(spark, sf):
    m = td.matches(spark, sf)
    cols = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr", "season"]
    base = SRC.scratch_dir(spark, "stream")
    # the table before the refresh: the refreshed season is stale (goals zeroed)
    stale = m.withColumn("fthg", F.when(F.col("season") == REFRESH_SEASON, F.lit(0)).otherwise(F.col("fthg")))
    fresh = m.filter(F.col("season") == REFRESH_SEASON).select(*cols)
    # two deliveries of several files, the older with wrong results and fewer matches, then the corrected one
    old = fresh.filter(F.col("match_id") % 3 != 0).withColumn("ftag", F.col("ftag") + 1)
    old.repartition(2).write.option("header", True).csv(f"{base}/landing/a")
    fresh.repartition(2).write.option("header", True).csv(f"{base}/landing/b")
    out = None
    for arrival, most in (("together", None), ("one by one", 1)):
        table = f"{base}/{arrival.replace(' ', '_')}"
        stale.select(*cols).write.partitionBy("season").parquet(table)
        stream_refresh(spark, f"{base}/landing/*", table, schema=_SCHEMA, checkpoint=f"{base}/ckpt-{most}", max_files=most)
        # replay from scratch: same files, new stream checkpoint
        stream_refresh(spark, f"{base}/landing/*", table, schema=_SCHEMA, checkpoint=f"{base}/ckpt-{most}-again", max_files=most)
        got = read_refreshed(spark, table, cols).select(*m.columns, F.lit(arrival).alias("arrival"))
        out = got if out is None else out.unionByName(got)
    return out
