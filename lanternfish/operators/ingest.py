"""Incremental ingest: classify, select work, upsert records and crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import record_complete
from ..schema import RECORD_FIELDS, STATE_FIELDS

# Backfill size of an incremental run.
BACKFILL_CAP = 25

MODES = ("incremental", "new-only", "full")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def join_sources(listing: DataFrame, records: DataFrame, state: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """One row per id with what each source knows: structs listed, record, state, fetched (or null).

    All sources are grouped on the id in a single shuffle; every source holds an id at most once.
    """

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias(name))

    parts = [part(listing, "listed"), part(records, "record"), part(state, "state")]
    if fetched is not None:
        parts.append(part(fetched, "fetched"))
    mixed = parts[0]
    for p in parts[1:]:
        mixed = mixed.unionByName(p, allowMissingColumns=True)
    names = [c for c in mixed.columns if c != "id"]
    return mixed.groupBy("id").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def change_class() -> Column:
    """new / changed / incomplete / unchanged for listed ids, null for others."""
    listed, record, state = F.col("listed"), F.col("record"), F.col("state")
    bootstrap = (
        (blank(state["sitemap_lastmod"]) == "")
        & blank(state["fetch_status"]).isin("", "bootstrap")
        & ((blank(record["url"]) == "") | (record["url"] == listed["url"]))
    )
    differs = (blank(state["url"]) != listed["url"]) | (blank(state["sitemap_lastmod"]) != blank(listed["sitemap_lastmod"]))
    complete = record_complete([record[f] for f in RECORD_FIELDS if f != "id"])
    return F.when(
        listed.isNotNull(),
        F.when(record.isNull(), "new")
        .when(state.isNotNull() & ~bootstrap & differs, "changed")
        .when(~complete, "incomplete")
        .otherwise("unchanged"),
    )


def classify_changes(listing: DataFrame, records: DataFrame, state: DataFrame) -> DataFrame:
    joined = join_sources(listing, records, state).where("listed is not null")
    return joined.select("id", change_class().alias("change"), blank(F.col("state.last_fetched_at")).alias("last_fetched_at"))


def select_work(classified: DataFrame, mode: str = "incremental", cap: int = BACKFILL_CAP) -> DataFrame:
    """Ids to fetch with the reason: new, changed, backfill or forced.

    The capped backfill is a top-k (never fetched first, then oldest fetch, then highest id), kept
    partial on every task; nothing is ranked globally.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "new-only":
        return classified.where("change = 'new'").select("id", F.lit("new").alias("reason"))
    if mode == "full":
        reason = F.when(F.col("change") == "incomplete", "backfill").when(F.col("change") == "unchanged", "forced")
        return classified.select("id", F.coalesce(reason, F.col("change")).alias("reason"))
    due = classified.where("change in ('new', 'changed')").select("id", F.col("change").alias("reason"))
    oldest = [
        (F.col("last_fetched_at") != "").asc(),
        F.col("last_fetched_at").asc(),
        F.col("id").try_cast("bigint").desc(),
    ]
    backfill = classified.where("change = 'incomplete'").orderBy(*oldest).limit(cap)
    return due.unionByName(backfill.select("id", F.lit("backfill").alias("reason")))


def fetch_status() -> Column:
    """Outcome of a fetch: ok, http_N, request_error or the reason of rejection."""
    f = F.col("fetched")
    code = F.coalesce(f["status_code"], F.lit(0))
    rejected = blank(f["rejection"]) != ""
    return F.when(
        f.isNotNull(),
        F.when(code == 0, F.lit("request_error"))
        .when(code != 200, F.concat(F.lit("http_"), code.cast("string")))
        .when(rejected, f["rejection"])
        .otherwise(F.lit("ok")),
    )


def merge_upsert(joined: DataFrame) -> DataFrame:
    """Next archive: a good fetch replaces or adds its record, everything else keeps the old one."""
    fresh = F.when(fetch_status() == "ok", F.col("fetched.record"))
    kept = F.coalesce(fresh, F.struct(*[F.col(f"record.{f}").alias(f) for f in RECORD_FIELDS if f != "id"]))
    present = joined.where((fetch_status() == "ok") | F.col("record").isNotNull())
    return present.select("id", *[kept[f].alias(f) for f in RECORD_FIELDS if f != "id"])


def next_state(joined: DataFrame, now: str, mode: str = "incremental") -> DataFrame:
    """Next crawl state of every id that is listed, stored or already tracked."""
    s, listed, record = F.col("state"), F.col("listed"), F.col("record")
    status = fetch_status()
    fetched = status.isNotNull()
    exists, is_listed = record.isNotNull(), listed.isNotNull()
    untouched = F.lit(mode == "new-only") & exists & ~fetched
    old = {name: blank(s[name]) for name in STATE_FIELDS}

    def or_else(c: Column, other: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), blank(other))

    carried = or_else(old["fetch_status"], F.when(exists, F.lit("bootstrap")).otherwise(F.lit("discovered")))
    # a row that was listed but not fetched counts as cached once it has a record
    settled = F.when(exists & carried.isin("", "bootstrap"), F.lit("cached")).otherwise(carried)
    good = status == "ok"
    listed_values = {
        "url": F.when(F.coalesce(good, F.lit(False)), F.col("fetched.record.url"))
        .when(untouched, or_else(old["url"], listed["url"]))
        .otherwise(listed["url"]),
        "sitemap_lastmod": F.when(untouched, old["sitemap_lastmod"]).otherwise(blank(listed["sitemap_lastmod"])),
        "first_seen_at": or_else(old["first_seen_at"], F.lit(now)),
        "last_seen_at": F.lit(now),
        "last_fetched_at": F.when(fetched, F.lit(now)).otherwise(old["last_fetched_at"]),
        "fetch_status": F.coalesce(status, settled),
    }
    missing = ~is_listed & exists
    stored_values = dict(old)
    stored_values["url"] = F.when(missing, or_else(old["url"], record["url"])).otherwise(old["url"])
    stored_values["fetch_status"] = F.when(missing, F.lit("missing_from_sitemap")).otherwise(old["fetch_status"])
    return joined.where(is_listed | exists | s.isNotNull()).select(
        "id", *[F.when(is_listed, listed_values[n]).otherwise(stored_values[n]).alias(n) for n in STATE_FIELDS]
    )


def ingest_report(joined: DataFrame, work: DataFrame) -> DataFrame:
    """Counters of one ingest run, one row."""
    reasons = work.agg(
        F.count(F.when(F.col("reason") == "backfill", 1)).alias("backfilled"),
        F.count(F.when(F.col("reason") == "forced", 1)).alias("forced"),
    )
    status = fetch_status()
    change = change_class()
    listed, exists = F.col("listed").isNotNull(), F.col("record").isNotNull()

    def rows(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    warning = F.when(status == "ok", blank(F.col("fetched.warning"))).otherwise(F.lit(""))
    counted = joined.agg(
        rows(listed).alias("listed"),
        rows(status.isNotNull()).alias("fetched"),
        rows(listed & exists & status.isNull()).alias("reused"),
        rows(change == "new").alias("new"),
        rows(change == "changed").alias("changed"),
        rows(~listed & exists).alias("missing_from_sitemap"),
        rows(status == "http_404").alias("detail_404"),
        rows((status == "request_error") | (status.startswith("http_") & (status != "http_404"))).alias("request_error"),
        rows(status == "parse_error").alias("parse_error"),
        rows(status == "non_float_event").alias("non_float_event"),
        rows((status == "implausible_season_year") | (warning == "implausible_season_year")).alias(
            "implausible_season_year"
        ),
    )
    return counted.join(F.broadcast(reasons))


def enrich_from_previous(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """Blank url, image, location and title come from the previous record; its date always wins."""
    old = previous.select("id", F.struct("url", "image", "location", "title", "date_found").alias("_old"))
    joined = rows.join(old, "id", "left")

    def filled(c: str) -> Column:
        if c in ("url", "image", "location", "title"):
            return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_old.{c}"), F.lit(""))
        if c == "date_found":
            return F.coalesce(F.nullif(F.col("_old.date_found"), F.lit("")), F.col(c))
        return F.col(c)

    return joined.select(*[filled(c).alias(c) for c in rows.columns])
