"""Queries: crawl operations, deal pipeline, lookups against landed memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions.text import simplify_address
from proplytics.operators import crawlops, deals, enrich
from proplytics.plans import twins as D
from proplytics.plans.registry import query
from proplytics.plans.text_queries import simplified
from proplytics.plans.twins import dim, over
from proplytics.sources.dimensions import dimension
from proplytics.sources.views import with_views

AS_OF = "2024-02-01 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


# a job completes when its event says so; started a minute per listing before
JOBS = "jobs AS (SELECT *, CASE WHEN status IN ('completed', 'failed') THEN created_at END AS completed_at, created_at - INTERVAL 90 SECOND AS started_at FROM scrape_jobs)"


def jobs(s):
    ended = F.col("status").isin("completed", "failed")
    return s.scrape_jobs.withColumns(
        {"completed_at": F.when(ended, F.col("created_at")), "started_at": F.expr("created_at - INTERVAL 90 SECOND")}
    )


def _jobs(sql: str, extra: str = "") -> str:
    return with_views("scrape_jobs", extra=JOBS + (",\n" + extra if extra else "")) + sql


LAST = "row_number() OVER (PARTITION BY {by} ORDER BY completed_at DESC, id DESC)"


@query(
    "win01_latest_per_source",
    _jobs(f"SELECT source_id, id, completed_at, listings_found FROM (SELECT *, {LAST.format(by='source_id')} AS rn FROM jobs WHERE status = 'completed') WHERE rn = 1"),
)
def _latest(s):
    return crawlops.latest_completed(jobs(s), ["source_id"]).select("source_id", "id", "completed_at", "listings_found")


@query(
    "win02_freshness",
    _jobs(f"""SELECT source_id, prefecture_code, id, completed_at, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(completed_at))::DOUBLE / 1000000::DOUBLE AS elapsed_s
FROM (SELECT *, {LAST.format(by='source_id, prefecture_code')} AS rn FROM jobs WHERE status = 'completed') WHERE rn = 1"""),
)
def _freshness(s):
    return crawlops.freshness(jobs(s), now())


@query(
    "jn12_source_health",
    with_views("scrape_jobs", "listing_feed", extra=JOBS + ",\n" + dim("scrape_sources"))
    + f"""SELECT s.id, s.display_name, s.is_enabled, coalesce(c.n, 0) AS listing_count, j.completed_at AS last_scrape_time, j.listings_found FROM scrape_sources s
 LEFT JOIN (SELECT source, count(*) AS n FROM listing_feed GROUP BY source) c ON c.source = s.id
 LEFT JOIN (SELECT *, {LAST.format(by='source_id')} AS rn FROM jobs WHERE status = 'completed') j ON j.source_id = s.id AND j.rn = 1""",
)
def _health(s):
    return crawlops.source_health(dimension(s.spark, "scrape_sources"), s.listing_feed, jobs(s))


@query(
    "agg20_global_health",
    with_views("scrape_jobs", "properties", extra=JOBS)
    + """SELECT (SELECT count(*) FROM properties) AS property_count, source_id AS last_source, completed_at AS last_completed_at, listings_found AS last_listings_found
FROM jobs WHERE status = 'completed' ORDER BY completed_at DESC, id DESC LIMIT 1""",
)
def _global(s):
    return crawlops.global_health(s.properties, jobs(s))


# jobs left active for more than two hours before the end of the log count as failed
STALE = "TIMESTAMP '2024-01-30 22:00:00'"
RECENT = f"""recent AS (SELECT * REPLACE (CASE WHEN status IN ('pending', 'running') AND created_at < {STALE} THEN 'failed' ELSE status END AS status) FROM jobs)"""


def recent(s):
    stale = F.col("status").isin("pending", "running") & (F.col("created_at") < F.expr("TIMESTAMP_NTZ '2024-01-30 22:00:00'"))
    return jobs(s).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


@query(
    "agg09_active_slots",
    _jobs("""SELECT s.id AS source_id, count(r.id) AS active, greatest(3 - count(r.id), 0) AS slots FROM scrape_sources s
 LEFT JOIN (SELECT * FROM recent WHERE status IN ('pending', 'running')) r ON r.source_id = s.id WHERE s.is_enabled GROUP BY s.id""", RECENT + ",\n" + dim("scrape_sources")),
)
def _slots(s):
    return crawlops.active_slots(recent(s))


@query(
    "jn13_due_crawls",
    _jobs("""SELECT source_id, prefecture_code, 'pending' AS status, rn AS slot FROM (
 SELECT g.source_id, g.prefecture_code, 3 - coalesce(b.n, 0) AS slots, row_number() OVER (PARTITION BY g.source_id ORDER BY g.prefecture_code) AS rn
 FROM (SELECT s.id AS source_id, lpad(CAST(n AS VARCHAR), 2, '0') AS prefecture_code FROM scrape_sources s, (SELECT unnest(range(1, 48)) AS n) WHERE s.is_enabled) g
 LEFT JOIN (SELECT source_id, count(*) AS n FROM recent WHERE status IN ('pending', 'running') GROUP BY source_id) b ON b.source_id = g.source_id
 LEFT JOIN (SELECT source_id, prefecture_code, max(completed_at) AS last FROM recent WHERE status = 'completed' GROUP BY ALL) l ON l.source_id = g.source_id AND l.prefecture_code = g.prefecture_code
 WHERE NOT EXISTS (SELECT 1 FROM recent a WHERE a.status IN ('pending', 'running') AND a.source_id = g.source_id AND a.prefecture_code = g.prefecture_code)
 AND NOT coalesce(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(l.last) < 2592000, FALSE)) WHERE rn <= slots""", RECENT + ",\n" + dim("scrape_sources")),
)
def _due(s):
    return crawlops.due_crawls(recent(s), now(), interval_hours=720.0)


@query(
    "win07_dispatch_quota",
    with_views("scrape_jobs", extra=JOBS)
    + "SELECT source_id, prefecture_code, n FROM (SELECT source_id, prefecture_code, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY prefecture_code) AS rn FROM jobs GROUP BY source_id, prefecture_code) WHERE rn <= 3",
)
def _quota(s):
    pairs = s.scrape_jobs.groupBy("source_id", "prefecture_code").agg(F.count(F.lit(1)).alias("n_jobs"))
    first = crawlops.within_slots(pairs.withColumn("slots", F.lit(crawlops.MAX_CONCURRENT)))
    return first.select("source_id", "prefecture_code", F.col("n_jobs").alias("n"))


@query("agg08_listings_per_source", over("listing_feed", sql="SELECT source AS source_id, count(*) AS n FROM listing_feed GROUP BY source"))
def _per_source(s):
    return s.listing_feed.groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))


@query("agg11_job_status_counts", over("scrape_jobs", sql="SELECT status, count(*) AS n FROM scrape_jobs GROUP BY status"))
def _status(s):
    return crawlops.job_counts(s.scrape_jobs)


@query(
    "agg11_dashboard",
    over("scrape_jobs", extra=dim("scrape_sources"), sql="""SELECT (SELECT count(*) FROM scrape_sources WHERE is_enabled) AS enabled_sources,
 (SELECT count(*) FROM scrape_jobs WHERE status = 'running') AS running_sources"""),
)
def _dashboard(s):
    return crawlops.dashboard_counts(s.scrape_jobs)


@query("flt13_status_set", over("scrape_jobs", sql="SELECT id, source_id FROM scrape_jobs WHERE status IN ('pending', 'running')"))
def _status_set(s):
    return s.scrape_jobs.where(F.col("status").isin(crawlops.ACTIVE_STATES)).select("id", "source_id")


@query(
    "flt14_enabled_sources",
    over("scrape_jobs", extra=dim("scrape_sources"), sql="""SELECT s.id, s.display_name, count(j.id) AS jobs FROM scrape_sources s
 LEFT JOIN scrape_jobs j ON j.source_id = s.id WHERE s.is_enabled GROUP BY s.id, s.display_name"""),
)
def _enabled(s):
    counts = s.scrape_jobs.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("jobs"))
    return dimension(s.spark, "scrape_sources").where("is_enabled").join(counts, "id", "left").select(
        "id", "display_name", F.coalesce("jobs", F.lit(0).cast("bigint")).alias("jobs")
    )


@query(
    "flt17_jobs",
    over("scrape_jobs", sql="SELECT id, created_at FROM scrape_jobs WHERE source_id = 'homes' AND status = 'failed' ORDER BY created_at DESC, id LIMIT 50"),
)
def _job_filter(s):
    return crawlops.recent_jobs(s.scrape_jobs, 50, "homes", "failed").select("id", "created_at")


@query(
    "jn20_job_board",
    over("scrape_jobs", extra=dim("scrape_sources") + ",\n" + dim("prefectures"), sql="""SELECT j.id, j.status, s.display_name AS source_name, p.name_en AS prefecture_name
FROM scrape_jobs j LEFT JOIN scrape_sources s ON s.id = j.source_id LEFT JOIN prefectures p ON p.code = j.prefecture_code"""),
)
def _board(s):
    return crawlops.job_board(s.scrape_jobs).select("id", "status", "source_name", "prefecture_name")


@query(
    "dt05_job_duration",
    _jobs(f"""SELECT id, s AS seconds, CASE WHEN s < 60 THEN concat(CAST(floor(s + 0.5) AS BIGINT), 's') ELSE
 concat(CAST(floor(s + 0.5) AS BIGINT) // 60, 'm ', CAST(floor(s + 0.5) AS BIGINT) % 60, 's') END AS duration
FROM (SELECT id, (epoch_us(coalesce(completed_at, TIMESTAMP '{AS_OF}')) - epoch_us(started_at))::DOUBLE / 1000000::DOUBLE AS s FROM jobs)"""),
)
def _duration(s):
    return crawlops.with_duration(jobs(s), now()).select("id", "seconds", "duration")


_EVENTS = """events_by_job AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
 WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CAST(floor(value) AS INT) AS listings_found,
 CAST(floor(value) AS INT) // 3 AS listings_new, CAST(floor(value) AS INT) // 5 AS listings_updated, CASE WHEN event_type NOT IN ('signup', 'view', 'click', 'purchase') THEN concat('failed at ', CAST(event_id AS VARCHAR)) END AS error_message FROM events)"""


@query(
    "ups09_job_lifecycle",
    f"""WITH {_EVENTS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(listings_found, (ts, event_id)) AS listings_found,
 arg_max(listings_new, (ts, event_id)) AS listings_new, arg_max(listings_updated, (ts, event_id)) AS listings_updated, arg_max_null(error_message, (ts, event_id)) AS error_message, min(ts) AS created_at,
 min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS finished_at, count(*) AS n_events FROM events_by_job GROUP BY job_id""",
)
def _lifecycle(s):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed")
    log = s.events.select(
        F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), F.floor("value").cast("int").alias("listings_found"),
        F.floor(F.floor("value") / 3).cast("int").alias("listings_new"), F.floor(F.floor("value") / 5).cast("int").alias("listings_updated"),
        F.when(status == "failed", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error_message"),
    )
    return crawlops.fold_job_events(log)


# --- deals --------------------------------------------------------------------


@query("flt17_deals_by_stage", over("deals", sql="SELECT id, purchase_price FROM deals WHERE stage = 'renovation'"))
def _by_stage(s):
    return s.deals.where(F.col("stage") == "renovation").select("id", "purchase_price")


@query(
    "flt18_stage_check",
    over("deals", sql="""SELECT id, bad_stage FROM (SELECT id, CASE WHEN id % 10 = 0 THEN concat(stage, '?') ELSE stage END AS bad_stage FROM deals)
WHERE bad_stage NOT IN ('discovery','analysis','due_diligence','negotiation','purchase','renovation','listing','sale','completed','abandoned')"""),
)
def _stage_check(s):
    rows = s.deals.select("id", F.when(F.col("id") % 10 == 0, F.concat("stage", F.lit("?"))).otherwise(F.col("stage")).alias("bad_stage"))
    return rows.where(~deals.valid_stage(F.col("bad_stage")))


@query("flt19_active_deals", over("deals", sql="SELECT id, stage FROM deals WHERE stage NOT IN ('completed', 'abandoned')"))
def _active(s):
    return deals.active_deals(s.deals).select("id", "stage")


@query(
    "agg12_stage_counts",
    over("deals", extra=dim("deal_stages"), sql="""SELECT d.stage_order, d.stage, d.label, d.terminal, count(x.id) AS n FROM deal_stages d LEFT JOIN deals x ON x.stage = d.stage GROUP BY ALL"""),
)
def _stage_counts(s):
    return deals.stage_counts(s.deals)


@query("agg12_terminal_total", over("deals", sql="SELECT count(*) FILTER (stage IN ('completed', 'abandoned')) AS terminal_count FROM deals"))
def _terminal(s):
    return deals.terminal_total(s.deals)


@query(
    "agg13_stage_breakdown",
    over("deals", extra=dim("deal_stages"), sql="""SELECT coalesce(string_agg(concat(n, ' in ', lower(label)), ', ' ORDER BY stage_order), 'No active deals') AS breakdown
FROM (SELECT d.stage_order, d.label, count(x.id) AS n FROM deal_stages d JOIN deals x ON x.stage = d.stage WHERE NOT d.terminal GROUP BY ALL)"""),
)
def _breakdown(s):
    return deals.stage_breakdown(s.deals)


CHECK = """items AS (SELECT d.id AS deal_id, c.sort_order, c.category, c.item_name, c.description, (d.id + c.sort_order) % 3 = 0 AS is_completed FROM deals d CROSS JOIN checklist c)"""


@query(
    "ups07_deal_checklist",
    over("deals", extra=dim("checklist"), sql="SELECT d.id AS deal_id, c.sort_order, c.category, c.item_name, c.description, FALSE AS is_completed FROM deals d CROSS JOIN checklist c"),
)
def _checklist(s):
    return deals.checklist_items(s.deals)


@query(
    "win06_checklist_ordinal",
    over("deals", extra=dim("checklist"), sql="SELECT d.id AS deal_id, c.category, row_number() OVER (PARTITION BY d.id ORDER BY c.sort_order) - 1 AS position, c.item_name FROM deals d CROSS JOIN checklist c"),
)
def _ordinal(s):
    return deals.checklist_items(s.deals).select("deal_id", "category", F.col("sort_order").cast("bigint").alias("position"), "item_name")


@query(
    "agg14_checklist_progress",
    over("deals", extra=dim("checklist") + ",\n" + CHECK, sql="""SELECT deal_id, category, count(*) FILTER (is_completed) AS completed, count(*) AS total,
 count(*) FILTER (is_completed)::DOUBLE / count(*) * 100 AS pct FROM items GROUP BY GROUPING SETS ((deal_id, category), (deal_id))"""),
)
def _progress(s):
    items = deals.checklist_items(s.deals).withColumn("is_completed", (F.col("deal_id") + F.col("sort_order")) % 3 == 0)
    return deals.checklist_progress(items)


@query(
    "ups07_new_deals",
    over("properties", sql=f"SELECT id, id AS property_id, price_jpy AS purchase_price, 'discovery' AS stage, TIMESTAMP '{AS_OF}' AS created_at FROM properties WHERE status = 'active'"),
)
def _new_deals(s):
    asked = s.properties.where("status = 'active'").select("id", F.col("id").alias("property_id"), F.col("price_jpy").alias("purchase_price"))
    return deals.new_deals(asked, now()).drop("updated_at")


@query(
    "ups08_patch_deals",
    over("deals", sql="""SELECT d.id, coalesce(p.stage, d.stage) AS stage, coalesce(p.purchase_price, d.purchase_price) AS purchase_price, d.renovation_budget
FROM deals d LEFT JOIN (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'sale' END AS stage, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 10 END AS purchase_price FROM lineitem) p ON p.id = d.id"""),
)
def _patch(s):
    key = F.col("l_orderkey")
    patches = s.lineitem.select(
        key.alias("id"), F.when(key % 2 == 0, "sale").alias("stage"), F.when(key % 3 == 0, key * 10).alias("purchase_price")
    ).distinct()
    return deals.patch_deals(s.deals, patches, now()).select("id", "stage", "purchase_price", "renovation_budget")


@query(
    "ups08_toggle_items",
    over("deals", extra=dim("checklist") + ",\n" + CHECK, sql=f"""SELECT deal_id, item_name, coalesce(t.done, i.is_completed) AS is_completed, CASE WHEN t.done THEN TIMESTAMP '{AS_OF}' END AS completed_at
FROM items i LEFT JOIN (SELECT DISTINCT l_orderkey AS id, l_orderkey % 2 = 0 AS done FROM lineitem) t ON t.id = i.deal_id AND i.item_name = 'title_search'"""),
)
def _toggle(s):
    items = deals.checklist_items(s.deals).withColumns(
        {"is_completed": (F.col("deal_id") + F.col("sort_order")) % 3 == 0, "completed_at": F.lit(None).cast("timestamp_ntz"), "notes": F.lit(None).cast("string")}
    )
    key = F.col("l_orderkey")
    toggles = s.lineitem.select(
        key.alias("deal_id"), F.lit("title_search").alias("item_name"), (key % 2 == 0).alias("is_completed"), F.lit(None).cast("string").alias("notes")
    ).distinct()
    return deals.toggle_items(items, toggles, now()).select("deal_id", "item_name", "is_completed", "completed_at")


@query(
    "jn19_property_deal",
    over("properties", "deals", sql="""SELECT p.id, d.deal_id, d.deal_id IS NOT NULL AS has_deal FROM properties p
LEFT JOIN (SELECT property_id, min(id) AS deal_id FROM deals GROUP BY property_id) d ON d.property_id = p.id"""),
)
def _has_deal(s):
    return deals.with_deal(s.properties.select("id"), s.deals)


# --- landed memories ------------------------------------------------------------

_GAZETTEER = """gazetteer AS (SELECT address, min(lat) AS lat, min(lng) AS lng FROM (
 SELECT CASE WHEN id % 2 = 0 THEN address_ja ELSE {simple} END AS address, lat, lng FROM properties WHERE lat IS NOT NULL) GROUP BY address)""".format(
    simple=simplified("address_ja")
)
_GEOCODE = """geo AS (SELECT p.id, p.address_ja, p.lat AS old_lat, coalesce(p.lat, a.lat, b.lat) AS lat,
 CASE WHEN p.lat IS NOT NULL THEN p.lng WHEN a.lat IS NOT NULL THEN a.lng ELSE b.lng END AS lng
FROM properties p LEFT JOIN gazetteer a ON a.address = p.address_ja LEFT JOIN gazetteer b ON b.address = {simple})""".format(
    simple=simplified("p.address_ja")
)
_OUTCOME = "CASE WHEN old_lat IS NOT NULL THEN 'none' WHEN lat IS NOT NULL THEN 'success' ELSE 'failed' END"


def gazetteer(s):
    name = F.when(F.col("id") % 2 == 0, F.col("address_ja")).otherwise(simplify_address(F.col("address_ja")))
    return s.properties.where("lat IS NOT NULL").groupBy(name.alias("address")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))


@query(
    "jn21_gazetteer",
    with_views("properties", extra=_GAZETTEER + ",\n" + _GEOCODE) + f"SELECT id, lat, lng, {_OUTCOME} AS outcome FROM geo",
)
def _gazetteer(s):
    return enrich.geocode(s.properties.select("id", "address_ja", "lat", "lng"), gazetteer(s)).drop("address_ja")


@query(
    "geo06_backfill_stats",
    with_views("properties", extra=_GAZETTEER + ",\n" + _GEOCODE)
    + f"""SELECT count(*) FILTER (o <> 'none') AS total, count(*) FILTER (o = 'success') AS success, count(*) FILTER (o = 'failed') AS failed,
 count(*) FILTER (o = 'skipped') AS skipped FROM (SELECT {_OUTCOME} AS o FROM geo)""",
)
def _backfill(s):
    return enrich.outcome_stats(enrich.geocode(s.properties.select("id", "address_ja", "lat", "lng"), gazetteer(s)))


@query(
    "agg19_batch_outcomes",
    D.over("properties", "hazard_assessments", sql="""SELECT count(*) AS requested, count(h.property_id) AS assessed, count(*) - count(h.property_id) AS missing
FROM properties p LEFT JOIN hazard_assessments h ON h.property_id = p.id WHERE p.status = 'active'"""),
)
def _outcomes(s):
    p = s.properties.where("status = 'active'").select("id")
    h = s.hazard_assessments.select(F.col("property_id").alias("id"), F.lit(1).alias("hit"))
    n = F.count(F.lit(1))
    return p.join(h, "id", "left").agg(n.alias("requested"), F.count("hit").alias("assessed"), (n - F.count("hit")).alias("missing"))


@query(
    "jn22_translation_memory",
    """WITH pieces AS (SELECT doc_id, lang, text, i AS no, substring(text, i * 5000 + 1, 5000) AS piece FROM documents, unnest(range(0, greatest((length(text) + 4999) // 5000, 1))) AS t(i)),
memory AS (SELECT piece, min(concat(lang, ':', CAST(doc_id AS VARCHAR))) AS translated FROM pieces WHERE lang <> 'en' AND trim(text) <> '' GROUP BY 1)
SELECT doc_id, md5(CASE WHEN trim(text) = '' THEN text ELSE string_agg(coalesce(m.translated, p.piece), '' ORDER BY no) END) AS translated
FROM pieces p LEFT JOIN memory m ON m.piece = p.piece GROUP BY doc_id, text""",
)
def _translate(s):
    foreign = s.documents.where("lang <> 'en' AND trim(text) <> ''").select("lang", "doc_id", F.explode(enrich.pieces(F.col("text"))).alias("text"))
    known = foreign.groupBy("text").agg(F.min(F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"))).alias("translated"))
    rows = enrich.translate(s.documents.select("doc_id", "text"), known)
    return rows.select("doc_id", F.md5("translated").alias("translated"))


@query(
    "jn17_code_maps",
    over("properties", extra=dim("prefectures"), sql="""SELECT r.name_en, r.region, count(*) AS n FROM properties p JOIN prefectures r ON r.code = p.prefecture_code GROUP BY ALL"""),
)
def _codes(s):
    side = dimension(s.spark, "prefectures").select(F.col("code").alias("prefecture_code"), "name_en", "region")
    counts = s.properties.groupBy("prefecture_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(side, "prefecture_code").select("name_en", "region", "n")
