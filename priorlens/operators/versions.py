"""arXiv version histories and as-of selection.

``records`` is a long table: one row per provider record of a work, with
``audit_id, paper_id, base_id, ordinal, arxiv_version,
arxiv_latest_version_verified, arxiv_versions, dates, fulltext_urls``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..functions.dates import full_day
from ..session import cut_lineage

KEY = ["audit_id", "paper_id"]
VERSION_LOCK = "LATEST_VERIFIED_VERSION_AT_OR_BEFORE_CUTOFF"
LOCAL_METHOD = "LOCAL_LATEST_VERSION_METADATA"
HISTORY_METHOD = "ARXIV_API_COMPLETE_VERSION_HISTORY"


def exact_pdf_url(url: Column, base: Column, version: Column) -> Column:
    """Canonical versioned PDF link when ``url`` names exactly that file, else null.

    An arXiv host is public by itself, so only the scheme and the absence of
    credentials are left to check.
    """
    parts = ids.arxiv_url_parts(url)
    same = (parts["base"] == base) & (parts["version"] == version) & url.rlike("(?i)^https?://[^/?#@]+/")
    return F.when(same, F.concat(F.lit("https://arxiv.org/pdf/"), base, F.lit("v"), version.cast("string")))


def version_entries(records: DataFrame) -> DataFrame:
    """Verified versions per paper: ``version, submitted_at, pdf_url, conflict``.

    Listed versions come first; a version known only through its own record is
    filled from the record's first ``arxiv_vN`` date. Unverified, malformed and
    mismatched entries are dropped; disagreeing ones carry a ``conflict``.
    """
    listed = records.select(*KEY, "base_id", "ordinal", F.posexplode("arxiv_versions").alias("pos", "v"))
    parts = ids.arxiv_parts(F.col("v.identifier"))
    listed = listed.filter(F.col("v.verified") & (F.col("v.version") >= 1)).select(
        *KEY,
        "base_id",
        F.col("v.version").alias("version"),
        full_day(F.trim(F.col("v.submitted_at"))).alias("submitted_at"),
        exact_pdf_url(F.col("v.pdf_url"), F.col("base_id"), F.col("v.version")).alias("pdf_url"),
        F.struct("ordinal", "pos").alias("seen"),
        parts.alias("id_parts"),
    )
    listed = listed.filter(
        F.col("submitted_at").isNotNull() & (F.col("id_parts.base") == F.col("base_id")) & (F.col("id_parts.version") == F.col("version"))
    )
    own_source = F.concat(F.lit("arxiv_v"), F.col("arxiv_version").cast("string"))
    own_dates = F.filter("dates", lambda d: (d["source"] == own_source) & F.coalesce(d["verified"], F.lit(True)))
    own_urls = F.filter(
        F.transform("fulltext_urls", lambda u: exact_pdf_url(u, F.col("base_id"), F.col("arxiv_version"))), lambda u: u.isNotNull()
    )
    filled = records.filter("arxiv_version >= 1").select(
        *KEY,
        "base_id",
        F.col("arxiv_version").alias("version"),
        full_day(F.trim(F.get(own_dates, F.lit(0))["value"])).alias("submitted_at"),
        F.get(own_urls, F.lit(0)).alias("pdf_url"),
        F.struct("ordinal", F.lit(0).alias("pos")).alias("seen"),
    ).filter("submitted_at IS NOT NULL")
    # one pass over both kinds: listed entries decide, filled ones only count where nothing is listed
    both = listed.drop("id_parts").withColumn("own", F.lit(False)).unionByName(filled.withColumn("own", F.lit(True)))
    day, pdf = F.when(~F.col("own"), F.col("submitted_at")), F.when(~F.col("own"), F.col("pdf_url"))
    folded = both.groupBy(*KEY, "base_id", "version").agg(
        F.min_by("submitted_at", F.when(~F.col("own"), F.col("seen"))).alias("l_day"),
        F.min(pdf).alias("l_pdf"),
        F.when(F.min(day) != F.max(day), F.concat(F.lit("two records for version v"), F.col("version")))
        .when(F.min(pdf) != F.max(pdf), F.concat(F.lit("two PDF links for version v"), F.col("version")))
        .alias("conflict"),
        F.min_by(F.struct("submitted_at", "pdf_url"), F.when(F.col("own"), F.col("seen"))).alias("f"),
    )
    is_listed = F.col("l_day").isNotNull()
    return folded.select(
        *KEY, "base_id", "version", F.coalesce("l_day", "f.submitted_at").alias("submitted_at"), F.when(is_listed, F.col("l_pdf")).otherwise(F.col("f.pdf_url")).alias("pdf_url"), "conflict"
    )


def _gaps(have: Column) -> Column:
    """What is missing between 1 and the last of the sorted versions: ``2`` or ``4-9`` for each gap."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), have.cast("array<bigint>"))

    def gap(version: Column, i: Column) -> Column:
        first, last = F.get(before, i) + 1, version.cast("bigint") - 1
        return F.when(last == first, first.cast("string")).when(last > first, F.concat_ws("-", first.cast("string"), last.cast("string")))

    return F.array_compact(F.transform(have, gap))


def history_state(entries: DataFrame) -> DataFrame:
    """Per paper: greatest version, missing versions, date order, first conflict."""
    by_version = W.partitionBy(*KEY).orderBy("version")
    stepped = entries.withColumn("_prev", F.lag("submitted_at").over(by_version))
    state = stepped.groupBy(*KEY).agg(
        F.max("version").alias("latest"),
        F.array_sort(F.collect_set("version")).alias("_have"),
        F.coalesce(F.bool_and(F.col("_prev").isNull() | (F.col("submitted_at") >= F.col("_prev"))), F.lit(True)).alias("monotonic"),
        F.min("conflict").alias("conflict"),
    )
    return state.withColumn("missing_versions", _gaps(F.col("_have"))).withColumn("complete", F.size("missing_versions") == 0).drop("_have")


def version_list_gaps(versions: DataFrame) -> DataFrame:
    """Completeness of ``(paper_id, version)`` lists: duplicates and missing versions."""
    return (
        versions.groupBy("paper_id")
        .agg(F.max("version").alias("latest"), F.array_sort(F.collect_set("version")).alias("_have"), (F.count("*") - F.count_distinct("version")).alias("duplicates"))
        .select(
            "paper_id",
            "latest",
            "duplicates",
            _gaps(F.col("_have")).alias("missing_versions"),
        )
    )


def latest_verified(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Greatest version a record vouches for as the latest, if it has an entry."""
    best = (
        records.filter("arxiv_latest_version_verified AND arxiv_version >= 1").groupBy(*KEY).agg(F.max("arxiv_version").alias("version"))
    )
    return best.join(entries.select(*KEY, "version"), [*KEY, "version"], "left_semi").select(*KEY, F.col("version").alias("latest_verified"))


def select_as_of(entries: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """As-of join: greatest version submitted on or before the cutoff that has a PDF.

    ``cutoffs(audit_id, paper_id, cutoff)``. One shuffle on the paper key, and
    ``max_by`` combines before it.
    """
    eligible = entries.join(cutoffs.select(*KEY, "cutoff"), KEY).filter("submitted_at <= cutoff AND pdf_url IS NOT NULL")
    chosen = eligible.groupBy(*KEY).agg(F.max("version").alias("version"), F.max_by(F.struct("submitted_at", "pdf_url"), "version").alias("e"))
    return chosen.select(*KEY, "version", "e.submitted_at", "e.pdf_url")


def historical_source(papers: DataFrame, records: DataFrame, history: DataFrame) -> DataFrame:
    """Version each eligible arXiv paper must be read in, or the reason why none can be.

    ``papers(audit_id, id, arxiv_id, cutoff, cutoff_status)``. ``history`` has the
    columns of ``records`` keyed by ``base_id`` and stands for the complete
    version list of an identifier. The paper's own verified latest version is
    used when it already predates the cutoff; everything else fails closed.
    """
    wanted = papers.filter("cutoff_status = 'ELIGIBLE'").select(
        "audit_id", F.col("id").alias("paper_id"), ids.arxiv_key("arxiv_id").alias("base_id"), F.col("cutoff").cast("date").alias("cutoff")
    ).filter("base_id IS NOT NULL")
    local = cut_lineage(version_entries(records.join(wanted.select(*KEY), KEY, "left_semi")))
    state = history_state(local)
    latest = latest_verified(records, local)
    local_latest = (
        latest.join(local, KEY)
        .filter("version = latest_verified")
        .select(*KEY, "latest_verified", F.col("submitted_at").alias("l_date"), F.col("pdf_url").alias("l_url"))
    )

    by_base = history.select("base_id", "ordinal", "arxiv_version", "arxiv_latest_version_verified", "arxiv_versions", "dates", "fulltext_urls")
    remote = cut_lineage(version_entries(wanted.select(*KEY, "base_id").join(by_base, "base_id")))
    remote_state = history_state(remote).select(
        *KEY, F.col("latest").alias("r_latest"), F.col("missing_versions").alias("r_missing"), F.col("monotonic").alias("r_monotonic"), F.col("conflict").alias("r_conflict")
    )
    picked = select_as_of(remote, wanted).select(*KEY, F.col("version").alias("r_version"), F.col("submitted_at").alias("r_date"), F.col("pdf_url").alias("r_url"))

    row = wanted
    for side in (local_latest, state.select(*KEY, "latest", "complete", "monotonic", "conflict"), remote_state, picked):
        row = row.join(side, KEY, "left")
    use_local = F.coalesce((F.col("l_date") <= F.col("cutoff")) & F.col("l_url").isNotNull(), F.lit(False))
    missing = F.transform("r_missing", lambda v: v.cast("string"))
    error = (
        F.when(F.col("cutoff").isNull(), "paper has no full cutoff date")
        .when(F.col("conflict").isNotNull(), F.col("conflict"))
        .when(use_local & ~F.col("monotonic"), "versions are not in order of date")
        .when(use_local, F.lit(None).cast("string"))
        .when(F.col("r_conflict").isNotNull(), F.col("r_conflict"))
        .when(
            F.col("latest_verified").isNotNull() & ~F.col("r_latest").eqNullSafe(F.col("latest_verified")),
            F.concat(F.lit("history does not end at known version v"), F.col("latest_verified")),
        )
        .when(F.size("r_missing") > 0, F.concat(F.lit("history has gaps at versions: "), F.array_join(missing, ", ")))
        .when(~F.col("r_monotonic"), "versions are not in order of date")
        .when(F.col("r_version").isNull(), "no version was public by the cutoff")
    )
    row = row.withColumn("error", error).withColumn("_local", use_local & F.col("error").isNull())
    chosen = {
        "version": F.when(F.col("_local"), F.col("latest_verified")).otherwise(F.col("r_version")),
        "submitted_at": F.when(F.col("_local"), F.col("l_date")).otherwise(F.col("r_date")),
        "pdf_url": F.when(F.col("_local"), F.col("l_url")).otherwise(F.col("r_url")),
        "selection_method": F.when(F.col("_local"), LOCAL_METHOD).otherwise(HISTORY_METHOD),
        "history_complete": F.when(F.col("_local"), F.col("complete") & (F.col("latest") == F.col("latest_verified"))).otherwise(F.lit(True)),
        "version_lock": F.lit(VERSION_LOCK),
    }
    ok = F.col("error").isNull()
    return row.select(*KEY, "base_id", "cutoff", *[F.when(ok, c).alias(n) for n, c in chosen.items()], "error")


def same_version(requested_url: Column, final_url: Column) -> Column:
    """A download kept the explicitly requested version."""
    want, got = ids.arxiv_url_parts(requested_url), ids.arxiv_url_parts(final_url)
    return F.coalesce(want["version"].isNotNull() & (want["base"] == got["base"]) & (want["version"] == got["version"]), F.lit(False))
