"""Queries for findings, intelligence, exposure and table summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.operators import enrich, incidents, rules, summaries
from runwarden.operators import vulnerability as vuln
from runwarden.plans.behaviour_queries import DISTANCES, NUMBERS, SCORES, TOKENS, behaviour, check, r9
from runwarden.plans.detection_queries import ALLOW, RUNS, allowlists, detection, full, live_allowlists
from runwarden.plans.enrich_queries import LOOKBACK, PARENT_SQL, REPORTED_SQL, inventory, reported
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, DAY_US, DUCK, END_US, Tables, duck_prefix, finding_sql, intel_sql, trial_sql
from runwarden.session import ensure_checkpoint_dir
from runwarden.sources import readers, sinks


def text(c: F.Column) -> F.Column:
    return c.cast("string")


# --- documents built from the tables -----------------------------------------------------

# What the documents hold, in the checking SQL.  One order is one scan report.
REPORT_ROWS = """ri AS (SELECT 's' || l_orderkey AS scan_id, 'img' || (l_orderkey % 8) AS image_digest,
    CASE WHEN l_partkey % 11 = 0 THEN 'GHSA-' || l_partkey WHEN l_partkey % 13 = 0 THEN 'cve-2024-' || (l_partkey % 900)
      ELSE 'CVE-2024-' || lpad(cast(l_partkey AS varchar), 5, '0') END AS raw_id,
    'layer' || (l_suppkey % 5) AS target, CASE WHEN l_partkey % 7 > 0 THEN 'pkg' || (l_partkey % 40) END AS pkg,
    CASE WHEN l_linenumber = 1 THEN '/usr/bin/click-' || (l_partkey % 6) END AS path,
    CASE l_returnflag WHEN 'R' THEN '1.' || l_linenumber WHEN 'A' THEN '' END AS fixed,
    CASE WHEN l_linestatus = 'O' THEN CASE l_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'LOW'
      ELSE 'MEDIUM' END END AS sev,
    CASE WHEN l_tax > 0 THEN l_tax * 100 END AS v3, l_discount * 100 AS v2 FROM lineitem),
  nf AS (SELECT *, upper(raw_id) AS cve_id, coalesce(pkg, 'unknown') AS package_name, nullif(fixed, '') AS fixed_version,
      upper(coalesce(sev, 'UNKNOWN')) AS severity,
      CASE WHEN v3 IS NOT NULL AND v3 >= v2 THEN v3 ELSE v2 END AS cvss_score,
      CASE WHEN v3 IS NOT NULL AND v3 >= v2 THEN 'a-nvd' ELSE 'b-vendor' END AS cvss_source
    FROM ri WHERE regexp_matches(upper(raw_id), '^CVE-\\d{4}-\\d{4,}$'))"""


def report_documents(t: Tables) -> DataFrame:
    """(scan_id, image_digest, document): scanner reports as JSON text."""
    columns = ["l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_tax", "l_discount"]

    def item(row: F.Column) -> F.Column:
        part, line, tax, discount = row["l_partkey"], row["l_linenumber"], row["l_tax"], row["l_discount"]
        cvss = F.create_map(
            F.lit("a-nvd"),
            F.struct(F.lit(None).cast("double").alias("V2Score"), F.when(tax > 0, tax * 100).alias("V3Score")),
            F.lit("b-vendor"),
            F.struct((discount * 100).alias("V2Score"), F.lit(None).cast("double").alias("V3Score")),
        )
        layer = row["l_suppkey"] % 4
        severity = F.when(layer == 0, "critical").when(layer == 1, "High").when(layer == 2, "LOW").otherwise("MEDIUM")
        return F.struct(
            F.when(part % 11 == 0, F.concat(F.lit("GHSA-"), text(part)))
            .when(part % 13 == 0, F.concat(F.lit("cve-2024-"), text(part % 900)))
            .otherwise(F.concat(F.lit("CVE-2024-"), F.lpad(text(part), 5, "0")))
            .alias("VulnerabilityID"),
            F.when(part % 7 > 0, F.concat(F.lit("pkg"), text(part % 40))).alias("PkgName"),
            F.when(line == 1, F.concat(F.lit("/usr/bin/click-"), text(part % 6))).alias("PkgPath"),
            F.when(row["l_returnflag"] == "R", F.concat(F.lit("1."), text(line)))
            .when(row["l_returnflag"] == "A", "")
            .alias("FixedVersion"),
            F.when(row["l_linestatus"] == "O", severity).alias("Severity"),
            cvss.alias("CVSS"),
        )

    # Plain columns are shuffled, once; both groupings find their rows in place, and items are made of whole groups.
    key = F.col("l_orderkey")
    rows = t.raw("lineitem").select("l_orderkey", *columns).repartition("l_orderkey")
    layer = F.concat(F.lit("layer"), text(F.col("l_suppkey") % 5)).alias("Target")
    layers = rows.groupBy("l_orderkey", layer).agg(F.collect_list(F.struct(*columns)).alias("lines"))
    grouped = layers.groupBy("l_orderkey").agg(F.collect_list(F.struct("Target", "lines")).alias("layers"))
    result = lambda x: F.struct(x["Target"].alias("Target"), F.transform(x["lines"], item).alias("Vulnerabilities"))
    results = grouped.select("l_orderkey", F.transform("layers", result).alias("Results"))
    return results.select(
        F.concat(F.lit("s"), text(key)).alias("scan_id"),
        F.concat(F.lit("img"), text(key % 8)).alias("image_digest"),
        F.to_json(F.struct("Results")).alias("document"),
    )


def parse(df: DataFrame, schema: str) -> DataFrame:
    """Documents written to files and read back, with the columns that name them."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/documents/{uuid.uuid4().hex}"
    sinks.store_documents(df, folder)
    ids = ", ".join(f"`{n}` {k}" for n, k in df.dtypes if n != "document")
    return readers.stored_documents(df.sparkSession, folder, ids, schema)


def reports(t: Tables) -> DataFrame:
    return parse(report_documents(t), schemas.SCAN_REPORT)


FINDING_SELECT = """scan_id, image_digest, cve_id, target, package_name, path AS package_path, fixed_version, severity,
  round(cvss_score, 9) AS cvss_score, cvss_source"""


@query("vul1_normalize_findings", "WITH " + REPORT_ROWS + f" SELECT {FINDING_SELECT} FROM nf")
def normalize_findings(t: Tables) -> DataFrame:
    names = ["scan_id", "image_digest", "cve_id", "target", "package_name", "package_path", "fixed_version", "severity"]
    return vuln.normalize_findings(reports(t)).select(*names, r9("cvss_score"), "cvss_source")


@query(
    "vul1_severity_order",
    "WITH " + REPORT_ROWS + """ SELECT scan_id, cve_id, package_name, target, severity, row_number() OVER (PARTITION BY image_digest
      ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC,
      cve_id, package_name, target, scan_id, coalesce(fixed, ''), coalesce(path, ''), v2) AS rank FROM nf QUALIFY rank <= 20""",
)
def severity_order(t: Tables) -> DataFrame:
    rows = vuln.normalize_findings(reports(t)).withColumn(
        "severity_rank", vuln.severity_rank(F.col("severity"))
    )
    top = enrich.top_per_group(rows, ["image_digest"], [*vuln.severity_order(), F.asc("scan_id")], 20)
    names = ["scan_id", "cve_id", "package_name", "target", "severity"]
    return top.select(*names, F.col("rank").cast("bigint").alias("rank"))


@query(
    "vul2_best_cvss",
    """SELECT l_orderkey, l_linenumber, round(greatest(coalesce(l_tax * 100, 0), l_discount * 100), 9) AS score,
      CASE WHEN l_tax * 100 >= l_discount * 100 THEN 'first' ELSE 'second' END AS source FROM lineitem""",
)
def best_cvss(t: Tables) -> DataFrame:
    """Two sources per line; equal scores must pick the first."""
    none = F.lit(None).cast("string")

    def entry(v2: F.Column, v3: F.Column) -> F.Column:
        return F.struct(
            v2.cast("string").alias("V2Score"), none.alias("V2Vector"),
            v3.cast("string").alias("V3Score"), none.alias("V3Vector"),
        )

    scores = F.create_map(
        F.lit("first"), entry(F.lit("0"), F.col("l_tax") * 100),
        F.lit("broken"), entry(none, F.lit("n/a")),
        F.lit("second"), entry(F.col("l_discount") * 100, none),
    )
    best = vuln.best_cvss(scores)
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(best["score"], 9).alias("score"), best["source"].alias("source")
    )


@query(
    "vul3_extract_cves",
    "WITH " + REPORT_ROWS + " SELECT DISTINCT cve_id FROM nf",
)
def extract_cves(t: Tables) -> DataFrame:
    return vuln.extract_cves(reports(t))


def finding_ids(t: Tables) -> DataFrame:
    key = F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("l_linenumber")), text(F.col("l_partkey")), "target", "severity", "fixed_version")
    return t.findings.withColumn("finding_id", key)


def containers(t: Tables) -> DataFrame:
    """Containers of all images, with published ports on a quarter of the images."""
    rows = t.lifecycle.groupBy("image_digest", "container_id", "g").agg(F.bool_or("has_port").alias("p"))
    return rows.select("image_digest", "container_id", (F.col("p") & (F.col("g") % 4 == 0)).alias("published"))


STAGE_SQL = """fi AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || concat_ws('-', target, severity,
    fixed_version) AS finding_id FROM finding),
  cn AS (SELECT image_digest, bool_or(p) AS ports FROM (SELECT image_digest, bool_or(has_port AND g % 4 = 0) AS p
    FROM lc GROUP BY image_digest, container_id) GROUP BY 1),
  ob AS (SELECT DISTINCT image_digest, token FROM (SELECT image_digest, unnest([lower(executable),
      lower(regexp_extract(executable, '[^/]*$')), lower(process_name)]) AS token FROM ex) WHERE token <> ''),
  tk AS (SELECT DISTINCT finding_id, image_digest, unnest([lower(package_name), regexp_replace(lower(package_name), 'lib', ''),
      lower(regexp_extract(coalesce(package_path, ''), '[^/]*$'))]) AS token FROM fi),
  hit AS (SELECT DISTINCT finding_id FROM tk JOIN ob USING (image_digest, token) WHERE token <> ''),
  stg AS (SELECT fi.*, CASE WHEN hit.finding_id IS NOT NULL AND coalesce(ports, false) THEN 'runtime_observed_and_port_published'
      WHEN hit.finding_id IS NOT NULL THEN 'runtime_observed' WHEN ports IS NOT NULL THEN 'deployed'
      ELSE 'package_present' END AS evidence_stage
    FROM fi LEFT JOIN hit USING (finding_id) LEFT JOIN cn USING (image_digest))"""


def staged(t: Tables) -> DataFrame:
    return vuln.exposure_stage(finding_ids(t), containers(t), vuln.observed_programs(t.execs))


def stage_check(select: str) -> str:
    return duck_prefix("ex", "lc", "finding") + "," + STAGE_SQL + " " + select


@query("vul4_exposure_stage", stage_check("SELECT finding_id, evidence_stage FROM stg"))
def exposure_stage(t: Tables) -> DataFrame:
    return staged(t).select("finding_id", "evidence_stage")


@query(
    "vul5_published_ports",
    duck_prefix("lc") + """ SELECT event_id, (k % 4 = 0 AND k % 3 > 0) OR k % 5 = 0 AS published FROM lc""",
)
def published_ports(t: Tables) -> DataFrame:
    return t.lifecycle.select("event_id", vuln.has_published_ports(*_bindings(t)).alias("published"))


def _bindings(t: Tables) -> tuple[F.Column, F.Column]:
    """Port bindings and ports in use of a container, as inspections have them."""
    k = F.col("k")
    binding = F.array(F.struct(F.lit("0.0.0.0").alias("HostIp"), F.lit("80").alias("HostPort")))
    none = F.slice(binding, 1, 0)
    bindings = F.when(k % 4 == 0, F.create_map(F.lit("80/tcp"), F.when(k % 3 > 0, binding).otherwise(none)))
    ports = F.when(k % 2 == 0, F.create_map(F.lit("1/tcp"), F.lit(None).cast(t.spark.range(1).select(binding).schema[0].dataType)))
    ports = F.when(k % 5 == 0, F.create_map(F.lit("443/tcp"), binding)).otherwise(ports)
    return bindings, ports


@query("agg16_evidence_funnel", stage_check("""SELECT image_digest, count(*) AS package_present,
    count(*) FILTER (evidence_stage <> 'package_present') AS deployed,
    count(*) FILTER (evidence_stage LIKE 'runtime%') AS runtime_observed,
    count(*) FILTER (evidence_stage LIKE '%published') AS runtime_observed_and_port_published FROM stg GROUP BY 1"""))
def evidence_funnel(t: Tables) -> DataFrame:
    return vuln.evidence_funnel(staged(t), ["image_digest"])


@query("vul12_reachability", stage_check("SELECT finding_id FROM stg WHERE evidence_stage LIKE 'runtime%'"))
def reachability(t: Tables) -> DataFrame:
    return vuln.at_or_above(staged(t), "runtime_observed").select("finding_id")


UPSERT = """old AS (SELECT cve_id, epss_score, kev FROM intel),
  new AS (SELECT 'CVE-2024-' || lpad(cast(p_partkey AS varchar), 5, '0') AS cve_id, round(p_size / 100.0, 6) AS epss_score,
    p_size > 30 AS kev, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 = 1 END AS epss_ok,
    CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 = 1 END AS kev_ok, p_partkey % 5 = 0 AS returned FROM part WHERE p_partkey % 2 = 0)"""


@query(
    "vul6_intel_upsert",
    duck_prefix("intel") + "," + UPSERT + """ SELECT coalesce(new.cve_id, old.cve_id) AS cve_id,
      CASE WHEN e THEN new.epss_score ELSE old.epss_score END AS epss_score,
      coalesce(CASE WHEN k THEN new.kev ELSE old.kev END, false) AS kev,
      CASE WHEN e THEN 'current_fetch' WHEN new.cve_id IS NOT NULL THEN 'retained_previous' END AS epss_value_source,
      CASE WHEN k THEN 'current_fetch' WHEN new.cve_id IS NOT NULL THEN 'retained_previous' END AS kev_value_source
    FROM old FULL JOIN new ON old.cve_id = new.cve_id, LATERAL (SELECT new.cve_id IS NOT NULL AND (coalesce(epss_ok, true)
      OR returned) AS e, new.cve_id IS NOT NULL AND coalesce(kev_ok, true) AS k) x""",
)
def intel_upsert(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    new = t.raw("part").where(key % 2 == 0).select(
        F.concat(F.lit("CVE-2024-"), F.lpad(text(key), 5, "0")).alias("cve_id"),
        F.round(F.col("p_size") / 100.0, 6).alias("epss_score"),
        (F.col("p_size") > 30).alias("kev"),
        F.when(key % 3 > 0, key % 3 == 1).alias("epss_fetch_complete"),
        F.when(key % 4 > 0, key % 4 == 1).alias("kev_fetch_complete"),
        (key % 5 == 0).alias("epss_record_returned"),
    )
    return vuln.upsert_intel(t.intel, new)


@query(
    "vul7_frozen_snapshot",
    duck_prefix("finding", "intel") + """ SELECT scan_id, cve_id, l_linenumber, epss_score AS snapshot_epss, kev AS snapshot_kev
      FROM finding LEFT JOIN intel USING (cve_id)""",
)
def frozen_snapshot(t: Tables) -> DataFrame:
    rows = vuln.with_intel(t.findings, t.intel)
    return rows.select(
        "scan_id",
        "cve_id",
        "l_linenumber",
        F.col("intel_snapshot.epss_score").alias("snapshot_epss"),
        F.col("intel_snapshot.kev").alias("snapshot_kev"),
    )


@query(
    "jn9_finding_intel",
    duck_prefix("finding", "intel") + " SELECT scan_id, cve_id, l_linenumber FROM finding WHERE cve_id IN (SELECT cve_id FROM intel WHERE kev)",
)
def finding_intel(t: Tables) -> DataFrame:
    return vuln.exploited_only(t.findings, t.intel).select("scan_id", "cve_id", "l_linenumber")


SUMMARY = """count(*) AS finding_count, count(DISTINCT cve_id) AS distinct_cves,
  count(*) FILTER (fixed_version <> '') AS fixable_findings, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'UNKNOWN') AS unknown"""


@query("agg14_severity_summary", duck_prefix("finding") + f" SELECT scan_id, {SUMMARY} FROM finding GROUP BY 1")
def severity_summary(t: Tables) -> DataFrame:
    return vuln.severity_summary(t.findings, ["scan_id"])


@query(
    "vul8_scan_summary",
    duck_prefix("ex", "lc", "finding", "intel") + f""" SELECT scan_id, image_digest, {SUMMARY},
      count(*) FILTER (epss_score IS NOT NULL) AS epss_covered_findings, count(*) FILTER (kev) AS kev_findings,
      coalesce(any_value(c), 0) AS containers_observed, coalesce(any_value(e), 0) AS process_events_considered
    FROM finding LEFT JOIN intel USING (cve_id)
    LEFT JOIN (SELECT image_digest, count(DISTINCT container_id) AS c FROM lc GROUP BY 1) USING (image_digest)
    LEFT JOIN (SELECT image_digest, count(*) AS e FROM ex GROUP BY 1) USING (image_digest) GROUP BY ALL""",
)
def scan_summary(t: Tables) -> DataFrame:
    return vuln.scan_summary(t.findings, t.intel, containers(t), t.execs)


@query(
    "vul9_scan_key",
    """SELECT scan_key, min(o_orderkey) AS first_order, count(*) AS copies FROM (SELECT o_orderkey, sha256('{"image_digest":"img' || (o_orderkey % 8)
      || '","image_id":"iid' || (o_custkey % 20) || '","scan_reference":"initial","scanner_name":"scanner","scanner_version":"'
      || o_orderstatus || '","schema_version":"v1"}') AS scan_key FROM orders) GROUP BY 1""",
)
def scan_key(t: Tables) -> DataFrame:
    key = vuln.scan_key(
        F.concat(F.lit("img"), text(F.col("o_orderkey") % 8)),
        F.concat(F.lit("iid"), text(F.col("o_custkey") % 20)),
        F.lit("scanner"),
        F.col("o_orderstatus"),
        F.lit("v1"),
        F.lit("initial"),
    )
    return t.raw("orders").groupBy(key.alias("scan_key")).agg(
        F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("copies")
    )


@query(
    "vul10_list_order",
    duck_prefix("finding", "intel") + """ SELECT scan_id, cve_id, cvss_score, l_linenumber FROM finding
      WHERE image_digest = 'img3' AND severity = 'UNKNOWN' AND cve_id IN (SELECT cve_id FROM intel WHERE kev)
      ORDER BY cvss_score DESC NULLS FIRST, cve_id, scan_id, l_linenumber LIMIT 50""",
)
def list_order(t: Tables) -> DataFrame:
    rows = vuln.list_findings(t.findings, t.intel, digest="img3", severity="unknown", kev_only=True)
    ordered = rows.orderBy(*vuln.list_order(), "scan_id", "l_linenumber").limit(50)
    return ordered.select("scan_id", "cve_id", "cvss_score", "l_linenumber")


@query(
    "vul11_finding_dedupe",
    duck_prefix("finding") + """ SELECT cve_id, package_name, scan_id, l_linenumber FROM (SELECT *,
      CASE WHEN l_linenumber = 7 THEN scan_id || cve_id END AS finding_id FROM finding)
      QUALIFY row_number() OVER (PARTITION BY coalesce(finding_id, cve_id || '-' || package_name)
        ORDER BY l_orderkey, l_linenumber, target, l_partkey, severity) = 1""",
)
def finding_dedupe(t: Tables) -> DataFrame:
    rows = t.findings.withColumn(
        "finding_id", F.when(F.col("l_linenumber") == 7, F.concat("scan_id", "cve_id"))
    )
    kept = vuln.deduplicate_findings(rows, ["l_orderkey", "l_linenumber", "target", "l_partkey", "severity"])
    return kept.select("cve_id", "package_name", "scan_id", "l_linenumber")


# --- feeds -------------------------------------------------------------------------------

FEEDS = """ep AS (SELECT upper(cve) AS cve_id, s AS epss_score, p AS epss_percentile, d AS epss_date FROM (
    SELECT 'cve-2024-' || lpad(cast(p_partkey % 1500 AS varchar), 5, '0') AS cve, p_partkey,
      try_cast(CASE WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE cast(p_size / 100.0 AS varchar) END AS double) AS s,
      p_size / 50.0 AS p, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-0' || (p_partkey % 9 + 1) END AS d FROM part)
    WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(cve) ORDER BY p_partkey DESC) = 1),
  kv AS (SELECT 'CVE-2024-' || lpad(cast(p_partkey % 700 AS varchar), 5, '0') AS cve_id, p_brand AS kev_vendor_project,
      p_name AS kev_product FROM part
    QUALIFY row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey DESC) = 1)"""


def _feed(t: Tables, rows: DataFrame, field: str, entry: F.Column) -> DataFrame:
    """Feed documents of a hundred entries each, as JSON text."""
    doc = F.floor(F.col("p_partkey") / 100).alias("doc")
    grouped = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("s"))
    entries = F.transform("s", lambda x: x["e"]).alias(field)
    return grouped.select("doc", F.to_json(F.struct(entries)).alias("document"))


def epss_documents(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    entry = F.struct(
        F.concat(F.lit("cve-2024-"), F.lpad(text(key % 1500), 5, "0")).alias("cve"),
        F.when(key % 17 == 0, "n/a").otherwise(text(F.col("p_size") / 100.0)).alias("epss"),
        text(F.col("p_size") / 50.0).alias("percentile"),
        F.when(key % 2 == 0, F.concat(F.lit("2024-01-0"), text(key % 9 + 1))).alias("date"),
    )
    return _feed(t, t.raw("part"), "data", entry)


def kev_documents(t: Tables) -> DataFrame:
    entry = F.struct(
        F.concat(F.lit("CVE-2024-"), F.lpad(text(F.col("p_partkey") % 700), 5, "0")).alias("cveID"),
        F.col("p_brand").alias("vendorProject"),
        F.col("p_name").alias("product"),
    )
    return _feed(t, t.raw("part"), "vulnerabilities", entry)


@query("src6_read_epss", "WITH " + FEEDS + " SELECT * FROM ep")
def read_epss(t: Tables) -> DataFrame:
    return vuln.read_epss(parse(epss_documents(t), schemas.EPSS_FEED))


@query("src7_read_kev", "WITH " + FEEDS + " SELECT cve_id, true AS kev, kev_vendor_project, kev_product FROM kv")
def read_kev(t: Tables) -> DataFrame:
    out = vuln.read_kev(parse(kev_documents(t), schemas.KEV_FEED))
    return out.select("cve_id", "kev", "kev_vendor_project", "kev_product")


@query(
    "jn10_merge_intel",
    "WITH " + FEEDS + """ SELECT cve_id, epss_score, kv.cve_id IS NOT NULL AS kev, kev_product, ep.cve_id IS NOT NULL AS epss_record_returned,
      kv.cve_id IS NOT NULL AS kev_record_returned
    FROM (SELECT DISTINCT 'CVE-2024-' || lpad(cast(l_partkey AS varchar), 5, '0') AS cve_id FROM lineitem)
    LEFT JOIN ep USING (cve_id) LEFT JOIN kv USING (cve_id)""",
)
def merge_intel(t: Tables) -> DataFrame:
    epss = vuln.read_epss(parse(epss_documents(t), schemas.EPSS_FEED))
    kev = vuln.read_kev(parse(kev_documents(t), schemas.KEV_FEED))
    out = vuln.merge_intel(t.findings, epss, kev)
    return out.select(
        "cve_id", "epss_score", "kev", "kev_product", "epss_record_returned", "kev_record_returned"
    )


SBOM_SQL = """co AS (SELECT 's' || (l_orderkey % 200) AS scan_id, CASE l_linenumber % 3 WHEN 0 THEN 'library' WHEN 1 THEN 'application' END AS type,
    CASE l_suppkey % 4 WHEN 0 THEN 'pkg:deb/debian/x' || l_partkey WHEN 1 THEN 'pkg:npm@' || l_partkey WHEN 2 THEN 'odd' END AS purl
    FROM lineitem)"""


def sbom_documents(t: Tables) -> DataFrame:
    line, supp = F.col("l_linenumber") % 3, F.col("l_suppkey") % 4
    component = F.struct(
        F.when(line == 0, "library").when(line == 1, "application").alias("type"),
        F.concat(F.lit("x"), text(F.col("l_partkey"))).alias("name"),
        F.when(supp == 0, F.concat(F.lit("pkg:deb/debian/x"), text(F.col("l_partkey"))))
        .when(supp == 1, F.concat(F.lit("pkg:npm@"), text(F.col("l_partkey"))))
        .when(supp == 2, "odd")
        .alias("purl"),
    )
    # Several documents per scan, one for each order.
    rows = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_list(component).alias("components"))
    scan = F.col("l_orderkey") % 200
    return rows.select(
        F.concat(F.lit("s"), text(scan)).alias("scan_id"),
        F.concat(F.lit("img"), text(scan % 8)).alias("image_digest"),
        F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), "components")).alias("document"),
    )


@query(
    "agg15_sbom_summary",
    "WITH " + SBOM_SQL + """ SELECT scan_id, kind, name, count(*) AS n FROM co, LATERAL (VALUES ('all', 'all'),
      ('type', coalesce(type, 'unknown')), ('ecosystem', nullif(regexp_extract(coalesce(purl, ''), '^pkg:([^/@]+)', 1), '')))
      v(kind, name) WHERE name IS NOT NULL GROUP BY ALL""",
)
def sbom_summary(t: Tables) -> DataFrame:
    return vuln.sbom_summary(vuln.sbom_components(parse(sbom_documents(t), schemas.SBOM)))


@query(
    "jn15_scan_detail",
    duck_prefix("finding", "intel") + "," + SBOM_SQL + """, cc AS (SELECT scan_id, count(*) AS components FROM co GROUP BY 1),
      sn AS (SELECT DISTINCT 's' || o_orderkey AS scan_id FROM orders)
    SELECT sn.scan_id, components, finding.cve_id, l_linenumber, epss_score, kev FROM sn LEFT JOIN cc USING (scan_id)
    LEFT JOIN finding USING (scan_id) LEFT JOIN intel ON intel.cve_id = finding.cve_id""",
)
def scan_detail(t: Tables) -> DataFrame:
    scans = t.raw("orders").select(F.concat(F.lit("s"), text(F.col("o_orderkey"))).alias("scan_id")).distinct()
    sizes = vuln.sbom_summary(vuln.sbom_components(parse(sbom_documents(t), schemas.SBOM)))
    out = vuln.scan_details(scans, t.findings, t.intel, sizes)
    return out.select("scan_id", "components", "cve_id", "l_linenumber", "epss_score", "kev")


@query(
    "jn14_container_dossier",
    check(TOKENS, DISTANCES, NUMBERS, SCORES, select="").rstrip() + "," + """
      hd AS (SELECT DISTINCT container_id, image_digest FROM ex),
      le AS (SELECT container_id, event_id, et, row_number() OVER (PARTITION BY container_id ORDER BY us DESC, event_id) AS rank
        FROM ex QUALIFY rank <= 20),
      fd AS (SELECT 'img' || (l_orderkey % 8) AS image_digest, 'CVE-2024-' || lpad(cast(l_partkey AS varchar), 5, '0') AS cve_id,
        CASE WHEN l_discount = 0 THEN NULL ELSE round(l_discount * 100, 1) END AS cvss_score FROM lineitem),
      wc AS (SELECT image_digest, cve_id, row_number() OVER (PARTITION BY image_digest ORDER BY cvss_score DESC NULLS FIRST, cve_id)
        AS rank FROM (SELECT DISTINCT * FROM fd) QUALIFY rank <= 15),
      ns AS (SELECT image_digest, arg_max(total, w) AS total FROM sc WHERE exec_count > 0 GROUP BY 1)
    SELECT container_id, 'execution' AS section, rank, event_id AS item FROM le
    UNION ALL SELECT DISTINCT container_id, 'sensor_rule', 1, 'rule-' || et FROM le
    UNION ALL SELECT DISTINCT container_id, 'detection_rule', 1, CASE WHEN action LIKE 'exec%' THEN 'DET-006' ELSE 'DET-007' END
      FROM lcw WHERE w >= 0 AND event_type = 'container' AND (action LIKE 'exec%' OR privileged)
        AND container_id IN (SELECT container_id FROM hd)
    UNION ALL SELECT container_id, 'score', 1, printf('%.6f', round(total, 12)) FROM hd JOIN ns USING (image_digest)
    UNION ALL SELECT container_id, 'cve', rank, cve_id FROM hd JOIN wc USING (image_digest)
    UNION ALL SELECT DISTINCT container_id, 'published_port', 1, port FROM (
      SELECT container_id, '80/tcp' AS port FROM lc WHERE k % 4 = 0 AND k % 3 > 0
      UNION ALL SELECT container_id, '443/tcp' FROM lc WHERE k % 5 = 0) WHERE container_id IN (SELECT container_id FROM hd)""",
)
def container_dossier(t: Tables) -> DataFrame:
    b = behaviour(t)
    execs = t.execs.withColumn("rule_name", F.concat(F.lit("rule-"), "et"))
    lifecycle = b.lifecycle.where("w >= 0")
    matches = rules.exec_activity(lifecycle).unionByName(rules.privileged_start(lifecycle))
    held = t.execs.select("container_id", "image_digest").distinct()
    ports = t.lifecycle.select("container_id", F.explode(vuln.published_ports(*_bindings(t))).alias("port"))
    return vuln.container_dossier(held, execs, b.scores(), t.findings, matches, ports, events=20)


# --- table summaries ---------------------------------------------------------------------


@query(
    "agg11_lifecycle_summary",
    duck_prefix("lc") + """ SELECT count(*) AS total_events, count(DISTINCT container_id) AS distinct_containers,
      count(*) FILTER (image_digest_status = 'resolved') AS resolved_digest_events,
      count(*) FILTER (container_id IS NOT NULL AND image_digest_status <> 'resolved') AS unresolved_digest_events FROM lc""",
)
def lifecycle_summary(t: Tables) -> DataFrame:
    return summaries.lifecycle_summary(t.lifecycle)


@query("agg11_by_action", duck_prefix("lc") + " SELECT action, count(*) AS n FROM lc GROUP BY 1")
def by_action(t: Tables) -> DataFrame:
    return summaries.count_by(t.lifecycle, "action")


@query(
    "agg12_exec_summary",
    duck_prefix("ex") + "," + REPORTED_SQL + "," + PARENT_SQL + """ SELECT count(*) AS total_events,
      count(DISTINCT CASE WHEN c = 1 THEN cid ELSE rid END) AS distinct_containers, count(*) FILTER (c = 1) AS resolved_events,
      count(*) FILTER (c IS NULL) AS unresolved_events, count(*) FILTER (c > 1) AS ambiguous_events,
      count(parent_event_id) AS linked_parent_events
    FROM rep LEFT JOIN hit USING (event_id) LEFT JOIN par USING (event_id)""",
)
def exec_summary(t: Tables) -> DataFrame:
    rows = enrich.apply_identity(enrich.resolve_container(reported(t), inventory(t)))
    links = enrich.correlate_parent(t.execs, LOOKBACK)
    return summaries.exec_summary(rows.join(links, "event_id", "left"))


@query(
    "agg12_top_names",
    duck_prefix("ex") + """ SELECT executable, count(*) AS n FROM ex WHERE executable IS NOT NULL GROUP BY 1
      ORDER BY n DESC, executable LIMIT 50""",
)
def top_names(t: Tables) -> DataFrame:
    return summaries.top_names(t.execs, "executable")


SYSTEM_SQL = """
  rec AS (SELECT inc.incident_id, c.container_id FROM inc LEFT JOIN (SELECT DISTINCT image_digest, w, container_id FROM m2
    WHERE by_id IS NULL AND container_id IS NOT NULL) c USING (image_digest, w)),
  beat AS (SELECT DISTINCT event_type, user_id % 50 AS i FROM events)"""


@query(
    "agg13_system_counts",
    full(ALLOW, RUNS, SYSTEM_SQL, f"finding AS ({finding_sql(DUCK)})", f"intel AS ({intel_sql(DUCK)})", f"trial AS ({trial_sql(DUCK, 'base')})",
         select="""SELECT 'process_exec_events' AS name, count(*) AS n FROM ex
    UNION ALL SELECT 'root_exec_events', count(*) FILTER (user_uid = 0) FROM ex
    UNION ALL SELECT 'runtime_events', count(*) FROM lc
    UNION ALL SELECT 'resolved_runtime_events', count(*) FILTER (image_digest_status = 'resolved') FROM lc
    UNION ALL SELECT 'registered_services', count(*) FROM beat
    UNION ALL SELECT 'known_containers', count(DISTINCT container_id) FROM lc
    UNION ALL SELECT 'known_images', count(DISTINCT image_digest) FROM lc
    UNION ALL SELECT 'behavior_profiles', count(DISTINCT image_digest) FROM base_tok
    UNION ALL SELECT 'anomaly_scores', count(*) FROM sc
    UNION ALL SELECT 'scored_anomaly_scores', count(*) FILTER (exec_count > 0) FROM sc
    UNION ALL SELECT 'insufficient_anomaly_scores', count(*) FILTER (exec_count = 0) FROM sc
    UNION ALL SELECT 'detection_allowlists', count(*) FROM al
    UNION ALL SELECT 'active_detection_allowlists', count(*) FROM live
    UNION ALL SELECT 'detection_runs', count(*) FROM runs
    UNION ALL SELECT 'runs_with_incident', count(*) FILTER (run_status = 'incident_created') FROM runs
    UNION ALL SELECT 'incidents', count(*) FROM inc
    UNION ALL SELECT 'open_incidents', count(*) FROM inc
    UNION ALL SELECT 'response_recommendations', count(*) FROM rec
    UNION ALL SELECT 'response_recommendations_with_target', count(container_id) FROM rec
    UNION ALL SELECT 'image_scans', count(*) FROM orders
    UNION ALL SELECT 'completed_image_scans', count(*) FILTER (o_orderstatus = 'F') FROM orders
    UNION ALL SELECT 'sbom_artifacts', count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'vulnerability_findings', count(*) FROM finding
    UNION ALL SELECT 'fixable_findings', count(*) FILTER (fixed_version IS NOT NULL) FROM finding
    UNION ALL SELECT 'kev_findings', count(*) FROM finding JOIN intel USING (cve_id) WHERE kev
    UNION ALL SELECT 'trials', count(*) FROM trial
    UNION ALL SELECT 'completed_trials', count(*) FILTER (status = 'completed') FROM trial"""),
)
def system_counts(t: Tables) -> DataFrame:
    """Sizes of all tables of the engine and of their subsets that an overview shows."""
    d, lifecycle, orders = detection(t), t.lifecycle, t.raw("orders")
    services = t.raw("events").select("event_type", F.col("user_id") % 50).distinct()
    recommended = incidents.recommend(d.incidents, d.containers)
    scored = {
        "scored_anomaly_scores": F.col("status") == "scored",
        "insufficient_anomaly_scores": F.col("status") == "insufficient_data",
    }
    return summaries.system_counts(
        {
            "process_exec_events": (t.execs, {"root_exec_events": F.col("user_uid") == 0}),
            "runtime_events": (lifecycle, {"resolved_runtime_events": F.col("image_digest_status") == "resolved"}),
            "registered_services": (services, {}),
            "known_containers": (lifecycle.select("container_id").where("container_id IS NOT NULL").distinct(), {}),
            "known_images": (lifecycle.select("image_digest").where("image_digest IS NOT NULL").distinct(), {}),
            "behavior_profiles": (d.behaviour.baseline.select("image_digest").distinct(), {}),
            "anomaly_scores": (d.scores, scored),
            "detection_allowlists": (allowlists(t), {}),
            "active_detection_allowlists": (live_allowlists(t), {}),
            "detection_runs": (d.runs, {"runs_with_incident": F.col("run_status") == "incident_created"}),
            "incidents": (d.incidents, {"open_incidents": F.col("status") == "open"}),
            "response_recommendations": (
                recommended, {"response_recommendations_with_target": F.col("container_id").isNotNull()},
            ),
            "image_scans": (orders, {"completed_image_scans": F.col("o_orderstatus") == "F"}),
            "sbom_artifacts": (t.raw("lineitem").select("l_orderkey").distinct(), {}),
            "vulnerability_findings": (t.findings, {"fixable_findings": F.col("fixed_version").isNotNull()}),
            "kev_findings": (vuln.exploited_only(t.findings, t.intel), {}),
            "trials": (t.trials, {"completed_trials": F.col("status") == "completed"}),
        }
    )


@query(
    "fn10_feed_freshness",
    duck_prefix("base", "ex") + f""", kn AS (SELECT DISTINCT sha256('c' || u) AS container_id, u % 9 <> 0 AS reachable FROM base),
      nw AS (SELECT container_id, max(us) AS us FROM ex WHERE u % 7 <> 0 GROUP BY 1)
    SELECT container_id, CASE WHEN reachable THEN round(({END_US} - us) / 1e6, 6) END AS age_seconds,
      CASE WHEN NOT reachable THEN 'unknown' WHEN us IS NULL THEN 'none' WHEN ({END_US} - us) / 1e6 <= 86400 THEN 'live'
        ELSE 'stale' END AS state FROM kn LEFT JOIN nw USING (container_id)""",
)
def feed_freshness(t: Tables) -> DataFrame:
    """Every container that was ever seen; some send no executions, some cannot be asked."""
    now = F.timestamp_micros(F.lit(END_US))
    known = t.base.select(
        F.sha2(F.concat(F.lit("c"), F.col("u").cast("string")), 256).alias("container_id"), (F.col("u") % 9 != 0).alias("reachable")
    ).distinct()
    out = summaries.feed_freshness(known, t.execs.where("u % 7 <> 0"), ["container_id"], now, DAY_US // 1_000_000)
    return out.withColumn("age_seconds", F.round("age_seconds", 6))


@query(
    "fn10_service_freshness",
    f"""SELECT event_type AS service_name, 'i' || (user_id % 50) AS instance_id, round(({END_US} - max(epoch_us(ts))) / 1e6, 6) AS age_seconds,
      ({END_US} - max(epoch_us(ts))) / 1e6 <= 3 * 3600 AS fresh FROM events GROUP BY ALL""",
)
def service_freshness(t: Tables) -> DataFrame:
    beats = t.raw("events").groupBy(
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("i"), text(F.col("user_id") % 50)).alias("instance_id"),
    ).agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen_at"))
    out = summaries.service_freshness(
        beats.withColumn("interval_seconds", F.lit(3600)), F.timestamp_micros(F.lit(END_US))
    )
    return out.withColumn("age_seconds", F.round("age_seconds", 6))
