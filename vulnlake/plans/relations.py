"""SQL text of the derived relations, for checking results in another engine."""

FINDINGS_LOG = """
log AS (
  SELECT
    n_name AS "group",
    s_name AS repo,
    'registry.example/' || lower(p_type) || ':' || p_size AS image,
    'CVE-' || (1999 + p_size // 2) || '-' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(5, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS cve,
    replace(p_name, ' ', '-') AS "packageName",
    l_linenumber || '.0' AS "packageVersion",
    '' AS path,
    'affects ' || p_name AS description,
    coalesce(CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END, '') AS "fixDate",
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published,
    'team-' || lower(l_returnflag) AS owner,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'critical'
         WHEN o_orderpriority LIKE '2%' THEN 'high'
         WHEN o_orderpriority LIKE '3%' THEN 'medium'
         WHEN o_orderpriority LIKE '5%' THEN 'low'
         ELSE 'unknown' END AS severity,
    p_brand AS "packageType",
    CASE WHEN l_returnflag = 'N' THEN 'Fixed in ' || l_linenumber
         WHEN l_returnflag = 'A' THEN 'open' ELSE 'affected' END AS status,
    o_orderstatus AS "advisoryType",
    CASE WHEN l_linenumber > 4 THEN 'container' ELSE 'library' END AS "buildType",
    'vulnerability' AS type,
    round(l_discount * 100, 1) AS cvss,
    CASE l_linenumber WHEN 1 THEN 'invalid - norisk' WHEN 2 THEN 'ai-invalid-norisk'
                      WHEN 3 THEN '' WHEN 4 THEN 'reviewed' END AS "kaiStatus",
    list_filter([CASE WHEN l_tax = 0 THEN 'Has fix' END,
                 CASE WHEN l_quantity > 25 THEN 'reachable' END,
                 CASE WHEN p_size < 10 THEN 'Remote' END], lambda x: x IS NOT NULL) AS "riskFactors",
    ['rule-' || lower(p_type)] AS "applicableRules",
    CAST(o_orderdate AS TIMESTAMP) AS "publishedAt",
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) END AS "fixedAt",
    CAST(l_shipdate AS TIMESTAMP) AS "updatedAt",
    CAST(l_shipdate AS TIMESTAMP) AS "firstSeenAt",
    l_quantity = 50 AS "isDeleted",
    l_orderkey AS batch,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS position
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
),
versions AS (
  SELECT *,
    md5("group" || chr(31) || repo || chr(31) || image || chr(31) || cve || chr(31)
        || "packageName" || chr(31) || "packageVersion" || chr(31) || path) AS "findingId",
    row_number() OVER (
      PARTITION BY "group", repo, image, cve, "packageName", "packageVersion", path
      ORDER BY "updatedAt" DESC, batch DESC, position DESC) AS age
  FROM log
),
findings AS (SELECT * FROM versions WHERE age = 1 AND NOT "isDeleted")
"""

CHANGES = """
upserts AS (
  SELECT * REPLACE (round(10 - cvss, 1) AS cvss, 'Fixed upstream' AS status)
  FROM findings WHERE severity = 'critical'
),
deletes AS (
  SELECT * FROM findings WHERE severity = 'low' AND "kaiStatus" = 'invalid - norisk'
)
"""

EVENTS = """
ev AS (
  SELECT *, epoch_us(ts) // 1000 AS ms, event_id AS seq, time_bucket(INTERVAL '9 hours', ts, TIMESTAMP '1970-01-01') AS w,
    (epoch_us(ts) // 1000) || '-' || event_id AS log_id,
    md5(CAST(user_id AS VARCHAR)) AS id1, md5(CAST(user_id + 1 AS VARCHAR)) AS id2,
    CASE event_type
      WHEN 'click' THEN 'finding-upserted' WHEN 'view' THEN 'findings-changed'
      WHEN 'error' THEN 'finding-deleted' WHEN 'purchase' THEN 'aggregates-invalidated'
      ELSE CASE WHEN value > 100 THEN 'resync-required' WHEN value > 50 THEN 'export-ready'
                ELSE 'dataset-version-changed' END END AS type
  FROM events
)
"""

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def iso(column: str) -> str:
    return ISO.format(f'"{column}"')


def over_findings(select: str, more: str = "") -> str:
    """A statement that may read log, versions and findings."""
    return f"WITH {FINDINGS_LOG}{', ' + more if more else ''} {select}"


def over_changes(select: str, more: str = "") -> str:
    return over_findings(select, CHANGES + (", " + more if more else ""))


def over_events(select: str, more: str = "") -> str:
    return f"WITH {EVENTS}{', ' + more if more else ''} {select}"
