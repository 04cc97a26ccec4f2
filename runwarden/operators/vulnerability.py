"""Scan findings, software inventories and threat intelligence joined to run-time evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import sha256_fields
from runwarden.functions.text import basename
from runwarden.operators.enrich import top_per_group

FINDING_KEY = ["scan_id", "cve_id", "package_name", "target", "package_path"]


def _text(value: Column, default: str | None = None) -> Column:
    filled = F.when(F.length(value) > 0, value)
    return filled if default is None else F.coalesce(filled, F.lit(default))


def best_cvss(scores: Column) -> Column:
    """Struct (score, vector, source) of the highest score; the first source wins ties.

    Version 3 is preferred within a source; sources without a readable score are skipped.
    """

    def candidate(entry: Column, position: Column) -> Column:
        value = entry["value"]
        modern = value["V3Score"].isNotNull()
        score = F.when(modern, value["V3Score"]).otherwise(value["V2Score"]).try_cast("double")
        vector = F.when(modern, value["V3Vector"]).otherwise(value["V2Vector"])
        return F.struct(
            score.alias("score"),
            (-position).alias("_first"),
            _text(vector).alias("vector"),
            entry["key"].alias("source"),
        )

    readable = F.filter(F.transform(F.map_entries(scores), candidate), lambda c: c["score"].isNotNull())
    best = F.array_max(readable)
    return F.when(
        best.isNotNull(),
        F.struct(best["score"].alias("score"), best["vector"].alias("vector"), best["source"].alias("source")),
    )


def report_items(reports: DataFrame) -> DataFrame:
    """One row per reported vulnerability.  reports: scan_id, image_digest, Results."""
    results = reports.select("scan_id", "image_digest", F.explode("Results").alias("r"))
    return results.select(
        "scan_id",
        "image_digest",
        _text(F.col("r.Target"), "unknown").alias("target"),
        _text(F.col("r.Class"), "unknown").alias("class_name"),
        _text(F.col("r.Type"), "unknown").alias("package_type"),
        F.explode("r.Vulnerabilities").alias("v"),
    )


def normalize_findings(reports: DataFrame) -> DataFrame:
    """Well-formed findings with defaults filled and the best CVSS score chosen."""
    cve = F.upper("v.VulnerabilityID")
    rows = report_items(reports).where(cve.rlike(config.CVE_PATTERN))
    references = F.filter("v.References", lambda r: F.length(r) > 0)
    cvss = best_cvss(F.col("v.CVSS"))
    return rows.select(
        "scan_id",
        "image_digest",
        cve.alias("cve_id"),
        "target",
        "class_name",
        "package_type",
        _text(F.col("v.PkgName"), "unknown").alias("package_name"),
        _text(F.col("v.PkgPath")).alias("package_path"),
        _text(F.col("v.InstalledVersion"), "unknown").alias("installed_version"),
        _text(F.col("v.FixedVersion")).alias("fixed_version"),
        _text(F.col("v.Status")).alias("status"),
        F.upper(_text(F.col("v.Severity"), "UNKNOWN")).alias("severity"),
        _text(F.col("v.SeveritySource")).alias("severity_source"),
        cvss.alias("cvss"),
        _text(F.col("v.Title")).alias("title"),
        _text(F.col("v.Description")).alias("description"),
        _text(F.col("v.PrimaryURL")).alias("primary_url"),
        references.alias("references"),
    ).select("*", *[F.col(f"cvss.{n}").alias(f"cvss_{n}") for n in ("score", "vector", "source")]).drop("cvss")


def severity_rank(severity: Column) -> Column:
    """0 for unknown up to 4 for critical."""
    order = config.FINDING_SEVERITIES[::-1]
    out = F.lit(0)
    for rank, name in enumerate(order):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_order() -> list[Column]:
    return [
        F.desc("severity_rank"),
        F.asc("cve_id"),
        F.asc("package_name"),
        F.asc("target"),
    ]


def extract_cves(reports: DataFrame) -> DataFrame:
    cve = F.upper("v.VulnerabilityID").alias("cve_id")
    return report_items(reports).select(cve).where(F.col("cve_id").rlike(config.CVE_PATTERN)).distinct()


def sbom_components(sboms: DataFrame) -> DataFrame:
    """One row per component.  sboms: scan_id, image_digest, components."""
    rows = sboms.select("scan_id", "image_digest", F.explode("components").alias("c"))
    purl = F.regexp_extract(F.coalesce("c.purl", F.lit("")), r"^pkg:([^/@]+)", 1)
    return rows.select(
        "scan_id",
        "image_digest",
        _text(F.col("c.type"), "unknown").alias("type"),
        F.col("c.name").alias("name"),
        _text(purl).alias("ecosystem"),
    )


def sbom_summary(components: DataFrame) -> DataFrame:
    """Component counts per scan, by type and by package ecosystem, as rows."""
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("all").alias("name")),
        F.struct(F.lit("type").alias("kind"), F.col("type").alias("name")),
        F.struct(F.lit("ecosystem").alias("kind"), F.col("ecosystem").alias("name")),
    )
    rows = components.select("scan_id", F.inline(kinds)).where("name IS NOT NULL")
    return rows.groupBy("scan_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


# --- intelligence ------------------------------------------------------------------------


def _last_by_position(rows: DataFrame) -> DataFrame:
    """The last occurrence of each CVE in (document, position) order."""
    columns = [c for c in rows.columns if c not in ("cve_id", "_doc", "_pos")]
    last = F.max_by(F.struct(*columns), F.struct("_doc", "_pos")).alias("_v")
    return rows.groupBy("cve_id").agg(last).select("cve_id", "_v.*")


def read_epss(feeds: DataFrame) -> DataFrame:
    """feeds: doc, data.  Entries whose numbers cannot be read are skipped."""
    rows = feeds.select(F.col("doc").alias("_doc"), F.posexplode("data").alias("_pos", "e"))
    parsed = rows.where(F.length("e.cve") > 0).select(
        F.upper("e.cve").alias("cve_id"),
        "_doc",
        "_pos",
        F.col("e.epss").try_cast("double").alias("epss_score"),
        F.col("e.percentile").try_cast("double").alias("epss_percentile"),
        _text(F.col("e.date")).alias("epss_date"),
    )
    readable = parsed.where("epss_score IS NOT NULL AND epss_percentile IS NOT NULL")
    return _last_by_position(readable)


def read_kev(feeds: DataFrame) -> DataFrame:
    """feeds: doc, vulnerabilities."""
    rows = feeds.select(F.col("doc").alias("_doc"), F.posexplode("vulnerabilities").alias("_pos", "e"))
    names = {
        "kev_date_added": "dateAdded",
        "kev_due_date": "dueDate",
        "kev_vendor_project": "vendorProject",
        "kev_product": "product",
        "kev_vulnerability_name": "vulnerabilityName",
        "kev_required_action": "requiredAction",
        "kev_known_ransomware_use": "knownRansomwareCampaignUse",
    }
    parsed = rows.where(F.length("e.cveID") > 0).select(
        F.upper("e.cveID").alias("cve_id"),
        "_doc",
        "_pos",
        F.lit(True).alias("kev"),
        *[F.col(f"e.{source}").alias(name) for name, source in names.items()],
    )
    return _last_by_position(parsed)


def merge_intel(cves: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Every distinct CVE with what the feeds said and whether they said anything."""
    e = epss.withColumn("_epss", F.lit(True))
    k = kev.withColumn("_kev", F.lit(True))
    joined = cves.select("cve_id").distinct().join(e, "cve_id", "left").join(k, "cve_id", "left")
    return joined.withColumns(
        {
            "epss_record_returned": F.col("_epss").isNotNull(),
            "kev_record_returned": F.col("_kev").isNotNull(),
            "kev": F.coalesce("kev", F.lit(False)),
        }
    ).drop("_epss", "_kev")


EPSS_COLUMNS = ["epss_score", "epss_percentile", "epss_date"]
KEV_COLUMNS = [
    "kev",
    "kev_date_added",
    "kev_due_date",
    "kev_vendor_project",
    "kev_product",
    "kev_vulnerability_name",
    "kev_required_action",
    "kev_known_ransomware_use",
]


def upsert_intel(old: DataFrame, new: DataFrame) -> DataFrame:
    """Intelligence after a fetch; fields of an incomplete feed keep their old values.

    new also has epss_fetch_complete, kev_fetch_complete and epss_record_returned; null
    flags of completeness mean complete.
    """
    columns = [c for c in EPSS_COLUMNS + KEV_COLUMNS if c in old.columns and c in new.columns]
    n, o = new.alias("n"), old.alias("o")
    joined = o.join(n, F.col("o.cve_id") == F.col("n.cve_id"), "full_outer")
    fetched = F.col("n.cve_id").isNotNull()
    epss_now = fetched & (
        F.coalesce("n.epss_fetch_complete", F.lit(True))
        | F.coalesce("n.epss_record_returned", F.lit(False))
    )
    kev_now = fetched & F.coalesce("n.kev_fetch_complete", F.lit(True))

    def pick(name: str) -> Column:
        use_new = epss_now if name in EPSS_COLUMNS else kev_now
        value = F.when(use_new, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        return (F.coalesce(value, F.lit(False)) if name == "kev" else value).alias(name)

    def origin(use_new: Column, alias: str) -> Column:
        return F.when(use_new, "current_fetch").when(fetched, "retained_previous").alias(alias)

    return joined.select(
        F.coalesce("n.cve_id", "o.cve_id").alias("cve_id"),
        *[pick(c) for c in columns],
        origin(epss_now, "epss_value_source"),
        origin(kev_now, "kev_value_source"),
    )


def with_intel(findings: DataFrame, intel: DataFrame) -> DataFrame:
    """Findings with the intelligence known now, frozen into them as a struct.

    Both sides are shuffled by CVE.  With a broadcast, findings that lie together in a file are all
    multiplied by the intelligence rows of their CVEs in the one task that reads them.
    """
    frozen = intel.select("cve_id", F.struct(*intel.columns).alias("intel_snapshot"))
    return findings.join(frozen.hint("merge"), "cve_id", "left")


def exploited_only(findings: DataFrame, intel: DataFrame) -> DataFrame:
    return findings.join(intel.where("kev").select("cve_id"), "cve_id", "left_semi")


# --- exposure ----------------------------------------------------------------------------


def published_ports(*bindings: Column) -> Column:
    """Sorted names of the ports that have a binding on the host, such as ``443/tcp``."""
    bound = [
        F.transform(F.filter(F.map_entries(b), lambda e: F.coalesce(F.size(e["value"]) > 0, F.lit(False))), lambda e: e["key"])
        for b in bindings
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*bound)))))


def has_published_ports(*bindings: Column) -> Column:
    """Some port of some binding map has a non-empty binding."""
    hits = [
        F.coalesce(F.exists(F.map_values(b), lambda v: F.coalesce(F.size(v) > 0, F.lit(False))), F.lit(False))
        for b in bindings
    ]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def package_tokens(name: Column, path: Column) -> Column:
    """Names under which a package may run: its name, without ``lib``, its file name."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    found = F.array(
        lowered,
        F.regexp_replace(lowered, "^(.*?)lib", "$1"),
        F.lower(basename(F.coalesce(path, F.lit("")))),
    )
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 0))


def observed_programs(execs: DataFrame) -> DataFrame:
    """Distinct (digest, token) from all executions, made distinct before the shuffle."""
    seen = execs.select("image_digest", "executable", "process_name").distinct()
    path, name = F.lower("executable"), F.lower("process_name")
    tokens = F.explode(F.array(path, basename(path), name, basename(name))).alias("token")
    return seen.select("image_digest", tokens).where(F.length("token") > 0).distinct()


def exposure_stage(findings: DataFrame, containers: DataFrame, programs: DataFrame) -> DataFrame:
    """Evidence stage of each finding.

    findings     finding_id, image_digest, package_name, package_path
    containers   image_digest, published (one row per container)
    programs     output of :func:`observed_programs`
    """
    tokens = package_tokens(F.col("package_name"), F.col("package_path"))
    wanted = findings.select("finding_id", "image_digest", F.explode(tokens).alias("token"))
    ran = wanted.join(programs, ["image_digest", "token"], "left_semi").select("finding_id").distinct()
    deployed = containers.groupBy("image_digest").agg(F.bool_or("published").alias("_ports"))
    joined = findings.join(ran.withColumn("_ran", F.lit(True)), "finding_id", "left").join(
        deployed, "image_digest", "left"
    )
    observed = F.col("_ran").isNotNull()
    running = F.col("_ports").isNotNull()
    ports = F.coalesce("_ports", F.lit(False))
    stage = (
        F.when(observed & ports, config.EVIDENCE_STAGES[3])
        .when(observed, config.EVIDENCE_STAGES[2])
        .when(running, config.EVIDENCE_STAGES[1])
        .otherwise(config.EVIDENCE_STAGES[0])
    )
    return joined.select(
        *findings.columns,
        stage.alias("evidence_stage"),
        observed.alias("matching_process_observed"),
        running.alias("container_running"),
        ports.alias("published_port_observed"),
    )


def stage_rank(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(config.EVIDENCE_STAGES):
        out = F.when(stage == name, rank).otherwise(out)
    return out


def at_or_above(findings: DataFrame, stage: str) -> DataFrame:
    return findings.where(stage_rank(F.col("evidence_stage")) >= config.EVIDENCE_STAGES.index(stage))


def evidence_funnel(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts: each stage counts the later ones too."""
    rank = stage_rank(F.col("evidence_stage"))
    return findings.groupBy(*keys).agg(
        *[F.count_if(rank >= i).alias(name) for i, name in enumerate(config.EVIDENCE_STAGES)]
    )


# --- summaries and lists -----------------------------------------------------------------


def severity_summary(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    fixed = F.length("fixed_version") > 0
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_distinct("cve_id").alias("distinct_cves"),
        F.count_if(fixed).alias("fixable_findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in config.FINDING_SEVERITIES],
    )


def scan_summary(findings: DataFrame, intel: DataFrame, containers: DataFrame, execs: DataFrame) -> DataFrame:
    """Per scan: severities, intelligence coverage and how much run-time evidence there was.

    Evidence is counted per digest before it meets the scans, intelligence per CVE before it meets the findings.
    """
    known = intel.groupBy("cve_id").agg(
        F.count("epss_score").alias("_epss"), F.count_if("kev").alias("_kev")
    )
    keys = ["scan_id", "image_digest"]
    base = severity_summary(findings, keys)
    coverage = findings.join(known, "cve_id", "left").groupBy(*keys).agg(
        F.coalesce(F.sum("_epss"), F.lit(0)).alias("epss_covered_findings"),
        F.coalesce(F.sum("_kev"), F.lit(0)).alias("kev_findings"),
    )
    running = containers.groupBy("image_digest").agg(F.count(F.lit(1)).alias("containers_observed"))
    ran = execs.groupBy("image_digest").agg(
        F.count(F.lit(1)).alias("process_events_considered")
    )
    joined = base.join(coverage, keys).join(running, "image_digest", "left").join(ran, "image_digest", "left")
    return joined.fillna(0, ["containers_observed", "process_events_considered"])


def scan_key(digest: Column, image_id: Column, name: Column, version: Column, schema: Column, reference: Column) -> Column:
    return sha256_fields(
        {
            "image_digest": digest,
            "image_id": image_id,
            "scanner_name": name,
            "scanner_version": version,
            "schema_version": schema,
            "scan_reference": reference,
        }
    )


def list_order() -> list[Column]:
    """Newest-risk-first order of finding lists; unscored findings come first."""
    return [F.desc_nulls_first("cvss_score"), F.asc("cve_id")]


def list_findings(
    findings: DataFrame,
    intel: DataFrame,
    digest: str | None = None,
    cve: str | None = None,
    severity: str | None = None,
    kev_only: bool = False,
) -> DataFrame:
    """Filtered findings; order with :func:`list_order`."""
    rows = exploited_only(findings, intel) if kev_only else findings
    if digest is not None:
        rows = rows.where(F.col("image_digest") == digest)
    if cve is not None:
        rows = rows.where(F.col("cve_id") == cve.upper())
    if severity is not None:
        if severity.upper() not in config.FINDING_SEVERITIES:
            raise ValueError(f"severity must be one of {sorted(config.FINDING_SEVERITIES)}")
        rows = rows.where(F.col("severity") == severity.upper())
    return rows


def deduplicate_findings(findings: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per finding id, or per (CVE, package) where there is none."""
    key = F.coalesce(_text(F.col("finding_id")), F.concat_ws("-", "cve_id", "package_name"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return findings.withColumn("_key", key).withColumn("_rank", rank).where("_rank = 1").drop("_key", "_rank")


def scan_details(scans: DataFrame, findings: DataFrame, intel: DataFrame, sbom: DataFrame) -> DataFrame:
    """One row per scan and finding with intelligence and the scan's component count.

    Rows and not nested arrays: a scan may have any number of findings.
    """
    sizes = sbom.where("kind = 'all'").select("scan_id", F.col("n").alias("components"))
    known = intel.select("cve_id", "epss_score", "kev")
    return (
        scans.join(sizes, "scan_id", "left")
        .join(findings.drop("image_digest"), "scan_id", "left")
        .join(known, "cve_id", "left")
    )


def container_dossier(
    containers: DataFrame,
    execs: DataFrame,
    scores: DataFrame,
    findings: DataFrame,
    matches: DataFrame,
    ports: DataFrame,
    events: int = 50,
    cves: int = 15,
) -> DataFrame:
    """What an auditor gets to see of each container, as (container_id, section, rank, item).

    Latest executions, latest score, worst CVEs of the image, sensor rules of the listed
    executions, detection rules that matched and published ports (``ports``: container_id, port),
    each under its own section name.
    """

    def section(rows: DataFrame, name: str, rank: Column, item: Column) -> DataFrame:
        return rows.select(
            "container_id", F.lit(name).alias("section"), rank.cast("bigint").alias("rank"), item.alias("item")
        )

    held = containers.select("container_id", "image_digest")
    latest = top_per_group(
        execs.select("container_id", "occurred_at", "event_id", "rule_name").join(
            held.select("container_id"), "container_id", "left_semi"
        ),
        ["container_id"],
        [F.desc("occurred_at"), F.asc("event_id")],
        events,
    )
    sensor = latest.where("rule_name IS NOT NULL").select("container_id", "rule_name").distinct()
    newest = (
        scores.where("status = 'scored'")
        .groupBy("image_digest")
        .agg(F.max_by("total_score", "w").alias("total_score"))
    )
    worst = top_per_group(
        findings.select("image_digest", "cve_id", "cvss_score").distinct(), ["image_digest"], list_order(), cves
    )
    rules = matches.select("container_id", "rule_id").distinct().join(
        held.select("container_id"), "container_id", "left_semi"
    )
    open_ports = ports.select("container_id", "port").distinct().join(held.select("container_id"), "container_id", "left_semi")
    one = F.lit(1)
    return (
        section(open_ports, "published_port", one, F.col("port"))
        .unionByName(section(latest, "execution", F.col("rank"), F.col("event_id")))
        .unionByName(section(sensor, "sensor_rule", one, F.col("rule_name")))
        .unionByName(section(rules, "detection_rule", one, F.col("rule_id")))
        .unionByName(
            section(
                held.join(newest, "image_digest"),
                "score",
                one,
                F.format_string("%.6f", "total_score"),
            )
        )
        .unionByName(section(held.join(worst, "image_digest"), "cve", F.col("rank"), F.col("cve_id")))
    )
