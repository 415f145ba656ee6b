"""The crawl store: a state table with one row per link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.operators.aggregates import named_counts


def _false(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def is_retryable(error: Column) -> Column:
    """Unknown errors are tried again."""
    return (F.coalesce(error, F.lit("")) == "") | F.lower(error).isin(L.RETRYABLE_ERRORS)


def may_retry(as_of: float, ignore_backoff: bool = False) -> Column:
    """Failed, not given up, a passing kind of error and its waiting time over."""
    hours = F.get(F.array(*[F.lit(h) for h in L.RETRY_BACKOFF_HOURS]), F.least("retry_count", F.lit(len(L.RETRY_BACKOFF_HOURS) - 1)))
    waited = F.coalesce(F.col("last_attempt"), F.lit(0.0)) == 0
    waited = waited | (F.lit(float(as_of)) - F.col("last_attempt") >= hours * 3600)
    rule = _false("extraction_failed") & ~_false("max_retries_reached") & is_retryable(F.col("error_reason"))
    return rule if ignore_backoff else rule & waited


def _limited(rows: DataFrame, k: int | None) -> DataFrame:
    return rows if k is None else rows.limit(k)


def url_pending(store: DataFrame, k: int | None = None) -> DataFrame:
    """Links not tried yet, oldest first."""
    rows = store.filter(~_false("extracted") & ~_false("extraction_failed"))
    return _limited(rows.orderBy("added_at", "url"), k)


def url_retryable(store: DataFrame, as_of: float, k: int | None = None, ignore_backoff: bool = False) -> DataFrame:
    """Failed links that may be tried again, longest waiting first."""
    rows = store.filter(may_retry(as_of, ignore_backoff))
    return _limited(rows.orderBy(F.coalesce("last_attempt", F.lit(0.0)), "url"), k)


def extract_plan(store: DataFrame, as_of: float, limit: int | None) -> DataFrame:
    """Pending links first, retries fill what is left of ``limit``; both parts are cut to it first."""
    pending = url_pending(store, limit).select("*", F.lit(0).alias("phase"), F.col("added_at").alias("since"))
    retries = url_retryable(store, as_of, limit).select("*", F.lit(1).alias("phase"), F.coalesce("last_attempt", F.lit(0.0)).alias("since"))
    return _limited(pending.unionByName(retries).orderBy("phase", "since", "url"), limit)


def url_apply_outcomes(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write crawl outcomes into the store.

    ``outcomes`` has one row per link: ``url, ok, attempted_at, fetch_method, is_spa, http_status,
    error_reason, is_retry``. Links that are not in the store are ignored.
    """
    fields = ("ok", "attempted_at", "fetch_method", "is_spa", "http_status", "error_reason", "is_retry")
    news = outcomes.select(F.regexp_replace("url", "/+$", "").alias("url"), F.struct(*[F.col(f) for f in fields]).alias("o"))
    joined = store.join(news, "url", "left")
    done = F.col("o").isNotNull() & F.col("o.ok")
    failed = F.col("o").isNotNull() & ~F.col("o.ok")
    retries = F.col("retry_count") + F.when(failed & F.col("o.is_retry"), F.lit(1)).otherwise(F.lit(0))
    over = failed & (~is_retryable(F.col("o.error_reason")) | (retries >= L.MAX_RETRIES))

    def keep(name: str) -> Column:
        return F.col(name)

    return joined.withColumns({
        "extracted": F.when(done, F.lit(True)).otherwise(keep("extracted")),
        "extraction_failed": F.when(done, F.lit(False)).when(failed, F.lit(True)).otherwise(keep("extraction_failed")),
        "last_attempt": F.coalesce("o.attempted_at", "last_attempt"),
        "fetch_method": F.when(done, F.coalesce(F.nullif("o.fetch_method", F.lit("")), keep("fetch_method"))).otherwise(keep("fetch_method")),
        "is_spa": F.when(done, F.coalesce("o.is_spa", F.lit(False))).otherwise(keep("is_spa")),
        "http_status": F.when(failed, F.coalesce(F.nullif("o.http_status", F.lit(0)), keep("http_status"))).otherwise(keep("http_status")),
        "error_reason": F.when(failed, F.coalesce(F.nullif("o.error_reason", F.lit("")), keep("error_reason"))).otherwise(keep("error_reason")),
        "max_retries_reached": F.when(over, F.lit(True)).otherwise(keep("max_retries_reached")),
        "retry_count": retries,
    }).drop("o")


def fold_outcomes(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The store after all ``outcomes`` of each link in time order, in one aggregate.

    The same columns as in ``url_apply_outcomes``, any number per link; of those with one link and time the
    smallest counts, so replays change nothing. Outcomes before a link's ``last_attempt`` still count as
    success or as a retry, but don't override what is known from later.
    """
    fields = ("ok", "fetch_method", "is_spa", "http_status", "error_reason", "is_retry")
    once = outcomes.groupBy(F.regexp_replace("url", "/+$", "").alias("url"), "attempted_at").agg(F.min(F.struct(*fields)).alias("o"))
    known = store.select("url", F.coalesce("last_attempt", F.lit(float("-inf"))).alias("known_at"))
    rows = once.select("url", "attempted_at", "o.*").join(known, "url")
    later, failed = F.col("attempted_at") > F.col("known_at"), ~F.col("ok")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(later & when, F.col("attempted_at")))

    method, status, reason = F.nullif("fetch_method", F.lit("")), F.nullif("http_status", F.lit(0)), F.nullif("error_reason", F.lit(""))
    folded = rows.groupBy("url").agg(
        F.max("ok").alias("any_ok"), F.max(failed).alias("any_failed"), last(F.col("ok"), F.lit(True)).alias("last_ok"),
        F.max("attempted_at").alias("at"), last(method, F.col("ok") & method.isNotNull()).alias("method"),
        last(F.coalesce("is_spa", F.lit(False)), F.col("ok")).alias("spa"), last(status, failed & status.isNotNull()).alias("status"),
        last(reason, failed & reason.isNotNull()).alias("reason"), F.count_if(failed & F.col("is_retry")).cast("int").alias("tries"),
        F.max(failed & ~is_retryable(F.col("error_reason"))).alias("hopeless"),
    )
    joined = store.join(folded, "url", "left")
    retries = F.col("retry_count") + F.coalesce("tries", F.lit(0))
    over = F.coalesce(F.col("hopeless") | (F.col("any_failed") & (retries >= L.MAX_RETRIES)), F.lit(False))
    return joined.withColumns({
        "extracted": F.when(F.col("any_ok"), F.lit(True)).otherwise(F.col("extracted")),
        "extraction_failed": F.coalesce(~F.col("last_ok"), "extraction_failed"),
        "last_attempt": F.greatest("last_attempt", "at"),
        "fetch_method": F.coalesce("method", "fetch_method"),
        "is_spa": F.coalesce("spa", "is_spa"),
        "http_status": F.coalesce("status", "http_status"),
        "error_reason": F.coalesce("reason", "error_reason"),
        "max_retries_reached": F.when(over, F.lit(True)).otherwise(F.col("max_retries_reached")),
        "retry_count": retries,
    }).select(*store.columns)


def url_reset_failed(store: DataFrame) -> DataFrame:
    """Failed links become pending again."""
    failed = _false("extraction_failed")
    return store.withColumns({
        "last_attempt": F.when(~failed, F.col("last_attempt")), "extraction_failed": F.lit(False),
    })


def url_store_totals(store: DataFrame, as_of: float) -> DataFrame:
    """Totals of the store as ``(category, n)`` rows, one pass."""
    extracted, failed = _false("extracted"), _false("extraction_failed")
    return named_counts(store, {
        "total": F.lit(True), "extracted": extracted, "failed": failed, "pending": ~extracted & ~failed,
        "spa": extracted & _false("is_spa"), "classic": extracted & ~_false("is_spa"),
        "retryable": may_retry(as_of, True), "ready_for_retry": may_retry(as_of),
        "permanently_failed": failed & _false("max_retries_reached"),
    })


def spa_percentage(store: DataFrame) -> DataFrame:
    extracted = _false("extracted")
    share = 100.0 * F.count_if(extracted & _false("is_spa")) / F.nullif(F.count_if(extracted), F.lit(0))
    return store.agg(F.coalesce(F.round(share, 1), F.lit(0.0)).alias("spa_percentage"))


def url_store_breakdown(store: DataFrame) -> DataFrame:
    """Counts by source (all), fetch method (extracted), error, status and retries (failed) in one pass.

    Each row gives its own (dimension, value) entries; the partial counts before the shuffle keep it small.
    """
    extracted, failed = _false("extracted"), _false("extraction_failed")

    def entry(dimension: str, value: Column, when: Column) -> Column:
        return F.when(when & value.isNotNull(), F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value")))

    entries = F.array_compact(F.array(
        entry("source", F.col("source"), F.lit(True)),
        entry("fetch_method", F.coalesce(F.nullif("fetch_method", F.lit("")), F.lit("unknown")), extracted),
        entry("error_reason", F.coalesce(F.nullif("error_reason", F.lit("")), F.lit("unknown")), failed),
        entry("http_status", F.nullif("http_status", F.lit(0)), failed),
        entry("retry_count", F.col("retry_count"), failed),
    ))
    return store.select(F.inline(entries)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def url_reachability_split(cfps: DataFrame, checks: DataFrame) -> DataFrame:
    """Calls with the status of their link and ``is_valid`` (below 400); unchecked links are status 0.

    The link is the call link, else the event link. Filter on ``is_valid`` for the two halves.
    """
    link = F.coalesce(F.nullif("cfp_url", F.lit("")), F.nullif("url", F.lit("")))
    joined = cfps.withColumn("__link", link).join(
        checks.select(F.col("url").alias("__link"), F.col("status").alias("__status")), "__link", "left"
    )
    status = F.coalesce("__status", F.lit(0))
    return joined.withColumns({"status": status, "is_valid": (status > 0) & (status < 400)}).drop("__link", "__status")
