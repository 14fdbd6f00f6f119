"""Check SQL for the catalog queries, written independently of the operators.

Each entry is one statement over the plain tables. Shared steps are common table
expressions, listed with the steps they need.
"""

from __future__ import annotations

from tidewatch.catalog.parameters import (
    AS_OF,
    DYNAMIC_SIZE,
    FLOW_MODEL,
    HOST,
    LEDGER_UNTIL,
    LINE_MEAN,
    LINE_MODEL,
    LINE_SIGMA,
    RETENTION_DAYS,
    SCORE_BIAS,
    SCORE_WEIGHTS,
    SPIKE_THRESHOLD,
    TRUSTED,
)
from tidewatch.config import SPARSE
from tidewatch.functions.entropy import bin_count
from tidewatch.operators.evaluate import TIMELINE, clock_seconds
from tidewatch.operators.spatial import PRIME, coefficients
from tidewatch.operators.volumetric import EntropyModel

P = SPARSE
FEATURES = ["velocity", "acceleration", "iat_mean", "sa_ratio", "jaccard_score", "entropy_shannon"]
CAPTURE = f"INTERVAL '{P.capture_seconds} seconds'"
EVALUATION = f"INTERVAL '{P.evaluation_seconds} seconds'"

STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, needs: list[str], body: str) -> None:
    STEPS[name] = (needs, body)


def sql(needs: list[str], body: str, recursive: str | None = None) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in STEPS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        add(need)
    parts = [f"{n} AS ({STEPS[n][1]})" for n in ordered]
    if recursive:
        parts.append(recursive)
    head = ("WITH RECURSIVE " if recursive else "WITH ") if parts else ""
    return head + ",\n".join(parts) + "\n" + body


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def r(expr: str, name: str, places: int = 6) -> str:
    """Rounded like the queries, without a negative zero."""
    return f"round({expr}, {places}) + 0.0 AS {name}"


def t(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def ratio(syn: str, ack: str) -> str:
    return f"CASE WHEN {ack} > 0 THEN CAST({syn} AS DOUBLE) / {ack} WHEN {syn} > 0 THEN 999.0 ELSE 0.0 END"


def mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / {n} ELSE 0.0 END"


def predicted(n: str, s: str, m: EntropyModel) -> str:
    terms = [n, s, f"{n}*{n}", f"{n}*{s}", f"{s}*{s}"]
    parts = [
        f"(({x}) - {d(c)}) / {d(q)} * {d(w)}"
        for x, c, q, w in zip(terms, m.center, m.scale, m.weights)
    ]
    return f"({d(m.intercept)} + " + " + ".join(parts) + ")"


def renyi(source: str, group: str, alpha: int = 10, most: int = 20) -> str:
    """Entropy per group and series of a table (group…, s, v)."""
    bins = "CASE total " + " ".join(f"WHEN {n} THEN {bin_count(n)}" for n in range(1, most + 1)) + " END"
    h = (
        "-sum(n / total * log2(n / total))"
        if alpha == 1
        else f"log2(sum(pow(n / total, {alpha}))) / (1 - {alpha})"
    )
    return f"""
SELECT {group}, s, {h} + 0.0 AS h FROM (
  SELECT {group}, s, bin, CAST(count(*) AS DOUBLE) AS n, CAST(any_value(total) AS DOUBLE) AS total FROM (
    SELECT *, CASE WHEN v < guess * (width / bins) + start THEN guess - 1
                   WHEN v >= (guess + 1) * (width / bins) + start AND guess <> bins - 1 THEN guess + 1
                   ELSE guess END AS bin FROM (
      SELECT *, least(floor((v - start) / width * bins), bins - 1) AS guess FROM (
        SELECT *, {bins} AS bins,
               CASE WHEN lo = hi THEN lo - CAST(0.5 AS DOUBLE) ELSE lo END AS start,
               CASE WHEN lo = hi THEN CAST(1 AS DOUBLE) ELSE hi - lo END AS width FROM (
          SELECT *, min(v) OVER p AS lo, max(v) OVER p AS hi, count(*) OVER p AS total
          FROM {source} WINDOW p AS (PARTITION BY {group}, s)))))
  GROUP BY {group}, s, bin) GROUP BY {group}, s"""


def pivoted(source: str, group: str) -> str:
    return f"""SELECT {group}, max(h) FILTER (s = 't_vol') AS h_t_vol,
max(h) FILTER (s = 'n_req') AS h_n_req, max(h) FILTER (s = 's_len') AS h_s_len FROM {source} GROUP BY {group}"""


def longer(source: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{c}' AS s, {c} AS v FROM {source}" for c in ("t_vol", "n_req", "s_len")
    )


def frames(source: str, key: str, size: int, full: bool) -> str:
    """The trailing frame of every row, one line per member."""
    only = f" AND a.rn >= {size}" if full else ""
    return f"""SELECT a.{key}, a.rn, b.t_vol, b.n_req, b.s_len FROM {source} a JOIN {source} b
ON a.{key} = b.{key} AND b.rn BETWEEN a.rn - {size - 1} AND a.rn{only}"""


def trailing(prefix: str, source: str, key: str, size: int, full: bool, model: EntropyModel) -> str:
    """Steps <prefix>_frames … <prefix>_moving; returns the name of the last one."""
    first = size if full else 2
    step(f"{prefix}_frames", [source], frames(source, key, size, full))
    step(f"{prefix}_long", [f"{prefix}_frames"], longer(f"{prefix}_frames", f"{key}, rn"))
    step(f"{prefix}_h", [f"{prefix}_long"], renyi(f"{prefix}_long", f"{key}, rn", most=size))
    step(f"{prefix}_wide", [f"{prefix}_h"], pivoted(f"{prefix}_h", f"{key}, rn"))
    step(
        f"{prefix}_residual",
        [f"{prefix}_wide"],
        f"""SELECT {key}, rn, CASE WHEN rn >= {first} THEN
abs(h_t_vol - {predicted('h_n_req', 'h_s_len', model)}) END AS residual FROM {prefix}_wide""",
    )
    step(
        f"{prefix}_moving",
        [f"{prefix}_residual"],
        f"""SELECT {key}, rn, residual,
coalesce(abs(residual - r1), 0) AS velocity, coalesce(abs((residual - r1) - (r1 - r2)), 0) AS acceleration
FROM (SELECT *, lag(residual, 1) OVER o AS r1, lag(residual, 2) OVER o AS r2
FROM {prefix}_residual WINDOW o AS (PARTITION BY {key} ORDER BY rn))""",
    )
    return f"{prefix}_moving"


# ---- steps over events --------------------------------------------------------------

step(
    "packets",
    [],
    """SELECT event_id AS packet_id, ts, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
'192.168.0.' || (k % 2) AS dst_ip, CAST(40000 + user_id % 100 AS INTEGER) AS src_port, dst_port,
CASE WHEN dst_port = 53 THEN 17 ELSE 6 END AS proto,
CASE WHEN dst_port = 53 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'click' THEN 16
     WHEN event_type = 'view' THEN 18 WHEN event_type = 'purchase' THEN 24 ELSE 4 END AS tcp_flags,
CAST(40 + floor(value) AS INTEGER) AS length
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 80 WHEN k % 10 = 1 THEN 53 ELSE 1000 + k % 20 END AS dst_port
      FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))""",
)
HOST_OF_URL = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
step(
    "dns",
    ["packets"],
    f"""SELECT p.packet_id, p.ts, p.src_ip AS source_ip, {HOST_OF_URL} AS domain FROM packets p
JOIN pages g ON g.page_id = p.packet_id % (SELECT count(*) FROM pages) WHERE p.proto = 17""",
)
step(
    "totals",
    ["packets"],
    f"""SELECT time_bucket({CAPTURE}, ts) AS w, sum(length) / {d(float(P.capture_seconds))} AS t_vol,
count(*) / {d(float(P.capture_seconds))} AS n_req, CAST(sum(length) AS DOUBLE) / count(*) AS s_len
FROM packets GROUP BY 1""",
)
step("tcp", ["packets"], f"SELECT *, time_bucket({CAPTURE}, ts) AS w FROM packets WHERE proto = 6")
step(
    "gaps",
    ["tcp"],
    f"""SELECT *, CASE WHEN epoch_us(w) - epoch_us(prev) <= CAST({P.flow_ttl_seconds} AS BIGINT) * 1000000
THEN epoch_us(ts) - epoch_us(prev) END AS gap FROM (SELECT *, lag(ts) OVER (
PARTITION BY src_ip, src_port, dst_ip, dst_port ORDER BY ts, packet_id) AS prev FROM tcp)""",
)
step(
    "flows",
    ["gaps", "totals"],
    """SELECT c.*, x.t_vol, x.n_req, x.s_len, row_number() OVER (PARTITION BY source_ip ORDER BY w) AS rn
FROM (SELECT w, src_ip AS source_ip, count(DISTINCT dst_port) AS unique_ports,
count(*) FILTER (tcp_flags & 2 <> 0) AS syn_count, count(*) FILTER (tcp_flags & 16 <> 0) AS ack_count,
coalesce(sum(gap), 0) / 1e6 AS iat_sum, count(gap) AS iat_count,
avg(gap / 1e6) AS gap_mean, stddev_pop(gap / 1e6) AS gap_std
FROM gaps GROUP BY ALL) c JOIN totals x USING (w)""",
)
FLOW_MOVING = trailing("flow", "flows", "source_ip", P.trailing_rows, False, FLOW_MODEL)

label = "split_part(domain, '.', 1)"
LETTERS = f"""SELECT domain, coalesce(sum(-n / total * log2(n / total)), 0) + 0.0 AS entropy FROM (
SELECT domain, letter, CAST(count(*) AS DOUBLE) AS n, CAST(any_value(length({label})) AS DOUBLE) AS total
FROM (SELECT domain, unnest(string_split({label}, '')) AS letter FROM (SELECT DISTINCT domain FROM {{}}))
WHERE letter <> '' GROUP BY domain, letter) GROUP BY domain"""
step("dns_entropy", ["dns"], LETTERS.format("dns"))

step(
    "sources",
    ["tcp"],
    f"SELECT DISTINCT w, dst_port AS target_port, src_ip FROM tcp WHERE dst_port = {P.target_port}",
)
FAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients(P.minhash_size)))
step("family", [], f"SELECT * FROM (VALUES {FAMILY}) f(i, a, b)")
step(
    "hashes",
    ["sources", "family"],
    f"""SELECT w, target_port, i, min((CAST(a AS HUGEINT) * ip + b) % {PRIME}) AS h FROM (
SELECT w, target_port, CAST(split_part(src_ip, '.', 1) AS HUGEINT) * 16777216
+ CAST(split_part(src_ip, '.', 2) AS HUGEINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS HUGEINT) * 256
+ CAST(split_part(src_ip, '.', 4) AS HUGEINT) AS ip FROM sources) CROSS JOIN family GROUP BY ALL""",
)
step("source_counts", ["sources"], "SELECT w, target_port, count(*) AS n_sources FROM sources GROUP BY ALL")
step(
    "similarity",
    ["hashes", "source_counts", "packets"],
    f"""SELECT c.w, c.target_port, c.n_sources, m.matches AS raw_matches,
CASE WHEN c.n_sources < {P.min_sources} OR m.matches IS NULL THEN 0 ELSE m.matches END AS matches
FROM source_counts c LEFT JOIN (SELECT a.w, a.target_port, count(*) FILTER (a.h = b.h) AS matches
FROM hashes a JOIN hashes b ON a.target_port = b.target_port AND a.i = b.i AND a.w = b.w + {CAPTURE}
GROUP BY ALL) m USING (w, target_port)
WHERE c.w > (SELECT time_bucket({CAPTURE}, min(ts)) FROM packets)""",
)
SCORE = f"matches / {d(float(P.minhash_size))}"

step(
    "stacked",
    [FLOW_MOVING, "flows", "similarity", "sources", "dns", "dns_entropy"],
    f"""SELECT w AS ts, source_ip, velocity, acceleration, CAST(NULL AS DOUBLE) AS jac, CAST(NULL AS DOUBLE) AS ent,
0 AS syn, 0 AS ack, 0 AS iat_sum, 0 AS iat_count FROM {FLOW_MOVING} JOIN flows USING (source_ip, rn)
UNION ALL SELECT w, source_ip, NULL, NULL, NULL, NULL, syn_count, ack_count, iat_sum, iat_count FROM flows
UNION ALL SELECT w, src_ip, NULL, NULL, {SCORE}, NULL, 0, 0, 0, 0 FROM similarity JOIN sources USING (w, target_port)
UNION ALL SELECT ts, source_ip, NULL, NULL, NULL, entropy, 0, 0, 0, 0 FROM dns JOIN dns_entropy USING (domain)""",
)
step(
    "features",
    ["stacked"],
    f"""SELECT w AS window_start, w + {EVALUATION} AS time, source_ip, velocity, acceleration,
{mean('iat_sum', 'iat_count')} AS iat_mean, {ratio('syn', 'ack')} AS sa_ratio, jaccard_score, entropy_shannon
FROM (SELECT time_bucket({EVALUATION}, ts) AS w, source_ip, coalesce(max(velocity), 0) AS velocity,
coalesce(max(acceleration), 0) AS acceleration, coalesce(max(jac), 0) AS jaccard_score,
coalesce(max(ent), 0) AS entropy_shannon, sum(syn) AS syn, sum(ack) AS ack,
sum(CAST(round(iat_sum * 1e6) AS BIGINT)) / 1e6 AS iat_sum, sum(iat_count) AS iat_count FROM stacked GROUP BY ALL)""",
)
Z = d(SCORE_BIAS) + "".join(f" + {c} * {d(w)}" for c, w in SCORE_WEIGHTS.items())
step("scored", ["features"], f"SELECT *, 1.0 / (1.0 + exp(-({Z}))) AS probability FROM features")

GUARD = f"""(sa_ratio > {P.guard_ratio} OR velocity > {P.guard_velocity} OR acceleration > {P.guard_acceleration}
OR jaccard_score >= {P.jaccard_threshold} OR entropy_shannon >= {P.guard_entropy})"""
QUIET = f"""(velocity = 0 AND acceleration = 0 AND iat_mean = 0 AND sa_ratio <= {P.quiet_ratio}
AND jaccard_score = 0 AND entropy_shannon < {P.quiet_entropy})"""


def posterior_steps(prefix: str, rows: str, needs: list[str]) -> None:
    """A recursive walk over the windows of each source; `rows` selects what takes part."""
    step(
        f"{prefix}_rows",
        needs,
        f"""SELECT source_ip, time, epoch_us(time) / 1000000 AS sec,
greatest(1e-5, least(1 - 1e-5, q)) AS a, row_number() OVER (PARTITION BY source_ip ORDER BY time) AS n
FROM ({rows})""",
    )
    prior = f"""CASE WHEN r.sec - w.sec > {P.gap_seconds}
THEN greatest(w.posterior * pow({d(P.decay)}, floor((r.sec - w.sec) / {P.step_seconds})), {d(P.base_prior)})
ELSE w.posterior END"""
    base = d(P.base_prior)
    step(
        f"{prefix}_walk",
        [f"{prefix}_rows"],
        f"""SELECT source_ip, time, sec, n, a * {base} / (a * {base} + (1 - a) * (1 - {base})) AS posterior
FROM {prefix}_rows WHERE n = 1
UNION ALL SELECT source_ip, time, sec, n, a * prior / (a * prior + (1 - a) * (1 - prior)) FROM (
SELECT r.source_ip, r.time, r.sec, r.n, r.a, {prior} AS prior
FROM {prefix}_walk w JOIN {prefix}_rows r ON r.source_ip = w.source_ip AND r.n = w.n + 1)""",
    )


posterior_steps("all", "SELECT *, probability AS q FROM scored", ["scored"])
posterior_steps(
    "lifted",
    f"""SELECT *, CASE WHEN {GUARD} THEN greatest(probability, {d(P.boost)}) ELSE probability END AS q
FROM scored WHERE NOT {QUIET} AND source_ip NOT IN ('127.0.0.1', '{HOST}')""",
    ["scored"],
)
step(
    "stored",
    ["scored", "lifted_walk"],
    f"""SELECT s.time, s.source_ip, {', '.join('s.' + c for c in FEATURES)}, {QUIET} AS quiet,
CASE WHEN {QUIET} THEN 0 ELSE p.posterior END AS probability,
CASE WHEN NOT {QUIET} AND p.posterior >= {P.attack_posterior} THEN 1 ELSE 0 END AS prediction,
date_diff('day', DATE '1970-01-01', CAST(s.time AS DATE)) AS batch
FROM scored s LEFT JOIN lifted_walk p USING (source_ip, time) WHERE s.source_ip NOT IN ('127.0.0.1', '{HOST}')""",
)
step(
    "alert_lines",
    ["stored"],
    f"""SELECT time, source_ip, probability, '[' || strftime(time, '%Y-%m-%d %H:%M:%S') ||
'] ALERT: Malicious Traffic from ' || source_ip || ' (Prob: ' || printf('%.2f', probability * 100) || '%)' AS line
FROM stored WHERE prediction = 1 AND probability >= {P.alert_posterior}""",
)
step("ledger", ["stored"], f"SELECT DISTINCT batch FROM stored WHERE time < TIMESTAMP '{LEDGER_UNTIL}'")
step(
    "pending",
    ["stored", "ledger"],
    f"""SELECT * FROM stored WHERE batch NOT IN (SELECT batch FROM ledger) AND time <= TIMESTAMP '{AS_OF}'""",
)
SURE = f"(probability <= {P.safe_probability} OR probability >= {P.confident_probability} OR source_ip = '{TRUSTED}')"
RELABEL = f"CASE WHEN source_ip = '{TRUSTED}' THEN 0 ELSE prediction END AS label"
RECENT = f"""FROM stored WHERE time > TIMESTAMP '{AS_OF}' - INTERVAL '{P.lookback_days} days' AND {SURE}"""

# ---- steps over lineitem ------------------------------------------------------------

step(
    "lines",
    [],
    """SELECT l_suppkey AS series, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS t_vol,
l_quantity AS n_req, l_discount AS s_len, l_tax, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_suppkey
ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem""",
)


def tumbling(size: int) -> str:
    name = f"windows{size}"
    step(
        name,
        ["lines"],
        f"""SELECT * FROM (SELECT *, (rn - 1) // {size} AS w, count(*) OVER (PARTITION BY series, (rn - 1) // {size}) AS rows_in
FROM lines) WHERE rows_in = {size}""",
    )
    return name


tumbling(20)
tumbling(5)
step("line_long", ["windows20"], longer("windows20", "series, w"))
step("line_h", ["line_long"], renyi("line_long", "series, w"))
step("line_wide", ["line_h"], pivoted("line_h", "series, w"))
step("line_h1", ["line_long"], renyi("line_long", "series, w", alpha=1))
step("line_wide1", ["line_h1"], pivoted("line_h1", "series, w"))
step(
    "line_fit",
    ["line_wide"],
    f"SELECT series, w, h_t_vol AS actual, {predicted('h_n_req', 'h_s_len', LINE_MODEL)} AS predicted FROM line_wide",
)
REC_MOVING = trailing("rec", "lines", "series", P.offline_rows, True, LINE_MODEL)
SPK_MOVING = trailing("spk", "lines", "series", 5, True, LINE_MODEL)
step(
    "line_domains",
    ["lines"],
    "SELECT *, l_returnflag || l_linestatus || l_partkey || '.com' AS domain FROM lines",
)
step("line_domain_entropy", ["line_domains"], LETTERS.format("line_domains"))
step(
    "recorded",
    [REC_MOVING, "line_domains", "line_domain_entropy"],
    f"""SELECT series, rn, velocity, acceleration, l_tax AS iat_mean,
{ratio('l_linenumber', '(l_partkey % 4)')} AS sa_ratio, CAST(0 AS DOUBLE) AS jaccard_score, entropy AS entropy_shannon,
1 AS label FROM {REC_MOVING} JOIN line_domains USING (series, rn) JOIN line_domain_entropy USING (domain)
WHERE rn >= {P.offline_rows + 1}""",
)
step(
    "spikes",
    [SPK_MOVING],
    f"""SELECT series, rn - 4 AS rn, residual, residual - 2 * lag(residual, 1) OVER o + lag(residual, 2) OVER o AS acceleration
FROM {SPK_MOVING} WHERE rn >= 5 WINDOW o AS (PARTITION BY series ORDER BY rn)""",
)
step(
    "spike_rows",
    ["spikes"],
    f"SELECT series, rn, row_number() OVER (PARTITION BY series ORDER BY rn) AS k FROM spikes WHERE abs(acceleration) > {SPIKE_THRESHOLD}",
)
step(
    "spike_walk",
    ["spike_rows"],
    """SELECT series, k, rn, rn AS last, TRUE AS hit FROM spike_rows WHERE k = 1
UNION ALL SELECT r.series, r.k, r.rn, CASE WHEN r.rn - w.last >= 3 THEN r.rn ELSE w.last END, r.rn - w.last >= 3
FROM spike_walk w JOIN spike_rows r ON r.series = w.series AND r.k = w.k + 1""",
)

# ---- steps for evaluation -----------------------------------------------------------

CLOCK = "((epoch_us(ts) % 86400000000) / 1e6)"


def inside(i) -> str:
    return f"{CLOCK} BETWEEN {clock_seconds(i.start)} AND {clock_seconds(i.end)}"


NUMBER = (
    "CASE "
    + " ".join(f"WHEN {inside(i)} THEN {n}" for n, i in reversed(list(enumerate(TIMELINE, 1))))
    + " ELSE 0 END"
)
TRUTH = "CASE " + " ".join(f"WHEN {inside(i)} THEN {i.is_attack}" for i in reversed(TIMELINE)) + " ELSE 0 END"
step(
    "detections",
    ["packets"],
    """SELECT dst_ip AS log, packet_id, ts, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 1 ELSE 0 END AS actual,
CASE WHEN length > 75 THEN 1 ELSE 0 END AS predicted FROM packets""",
)
step(
    "runs",
    ["detections"],
    """SELECT *, sum(CASE WHEN actual = before THEN 0 ELSE 1 END) OVER (PARTITION BY log ORDER BY ts, packet_id) AS run
FROM (SELECT *, lag(actual) OVER (PARTITION BY log ORDER BY ts, packet_id) AS before FROM detections)""",
)
step(
    "adjusted",
    ["runs"],
    """SELECT *, CASE WHEN actual = 1 THEN max(predicted) OVER (PARTITION BY log, run) ELSE predicted END AS adjusted FROM runs""",
)


def rates(source: str, guess: str) -> str:
    return f"""SELECT log, tp, tn, fp, fn, {r(mean('(tp + tn)', '(tp + tn + fp + fn)'), 'accuracy')},
{r(mean('fp', '(fp + tn)'), 'fpr')}, {r('recall', 'detection_rate')}, {r('prec', 'precision')},
{r('CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0 END', 'f1')}
FROM (SELECT *, {mean('tp', '(tp + fn)')} AS recall, {mean('tp', '(tp + fp)')} AS prec FROM (
SELECT log, count(*) FILTER (actual = 1 AND {guess} = 1) AS tp, count(*) FILTER (actual = 0 AND {guess} = 0) AS tn,
count(*) FILTER (actual = 0 AND {guess} = 1) AS fp, count(*) FILTER (actual = 1 AND {guess} = 0) AS fn
FROM {source} GROUP BY log))"""


step(
    "curve",
    ["packets"],
    """SELECT score, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM (SELECT length / CAST(500 AS DOUBLE) AS score,
count(*) FILTER ((packet_id * 7 + length) % 5 < 2) AS pos, count(*) FILTER ((packet_id * 7 + length) % 5 >= 2) AS neg
FROM packets GROUP BY 1) WINDOW o AS (ORDER BY score DESC)""",
)

MD5_ID = "md5('42-' || doc_id)"
# exact microsecond sums: enough places that no value sits half way between two
PLACES = {"iat_mean": 9}
FEATURES_ROUNDED = ", ".join(r(c, c, PLACES.get(c, 6)) for c in FEATURES)
H_ROUNDED = ", ".join(r(c, c) for c in ("h_t_vol", "h_n_req", "h_s_len"))
SERIES = ("t_vol", "n_req", "s_len")
FLOW_COLUMNS = f"""{t('w', 'window_start')}, source_ip, {r('t_vol', 't_vol')}, {r('n_req', 'n_req')}, {r('s_len', 's_len')},
unique_ports, syn_count, ack_count, {r('CAST(iat_sum AS DOUBLE)', 'iat_sum')}, iat_count"""

BALANCED_LINES = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity AS id,
CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS label FROM lineitem"""

ORACLES: dict[str, str] = {
    "transport_packets": sql(
        ["packets"],
        """SELECT proto, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets
WHERE packet_id % 10 <> 0 GROUP BY proto""",
    ),
    "flow_window_totals": sql(
        ["totals"],
        f"SELECT {t('w', 'window_start')}, {r('t_vol', 't_vol')}, {r('n_req', 'n_req')}, {r('s_len', 's_len')} FROM totals",
    ),
    "flow_per_ip": sql(["flows"], f"SELECT {FLOW_COLUMNS} FROM flows"),
    "bidirectional_flows": sql(
        ["packets"],
        f"""SELECT {t('w', 'window_start')}, ip_a, ip_b, port_a, port_b, proto,
{r(f'sum(length) / {d(float(P.capture_seconds))}', 'flow_byts_s')},
{r(f'count(*) / {d(float(P.capture_seconds))}', 'flow_pkts_s')}, {r('avg(length)', 'pkt_len_mean')}
FROM (SELECT time_bucket({CAPTURE}, ts) AS w, least(src_ip, dst_ip) AS ip_a, greatest(src_ip, dst_ip) AS ip_b,
least(src_port, dst_port) AS port_a, greatest(src_port, dst_port) AS port_b, proto, length FROM packets)
GROUP BY w, ip_a, ip_b, port_a, port_b, proto""",
    ),
    "iat_ttl": sql(
        ["gaps"],
        f"SELECT packet_id, src_ip AS source_ip, src_port, dst_ip, dst_port, {r('gap / 1e6', 'iat')} FROM gaps WHERE gap IS NOT NULL",
    ),
    "sa_ratio": sql(
        ["flows"],
        f"""SELECT {t('w', 'window_start')}, source_ip, {r(ratio('syn_count', 'ack_count'), 'sa_ratio')},
{r(mean('iat_sum', 'iat_count'), 'iat_mean', 9)} FROM flows""",
    ),
    "valid_ips": sql(
        ["packets"],
        r"""SELECT packet_id, ip FROM (SELECT packet_id, CASE WHEN packet_id % 3 = 0
THEN src_ip || '9' || length ELSE src_ip END AS ip FROM packets)
WHERE len(list_filter(string_split(ip, '.'), lambda x: TRY_CAST(x AS INTEGER) BETWEEN 0 AND 255
AND CAST(TRY_CAST(x AS INTEGER) AS VARCHAR) = x)) = 4 AND len(string_split(ip, '.')) = 4""",
    ),
    "ip_to_int": sql(
        ["packets"],
        """SELECT src_ip, count(*) AS packets, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216
+ CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256
+ CAST(split_part(src_ip, '.', 4) AS BIGINT) AS number, src_ip AS text FROM packets GROUP BY src_ip""",
    ),
    "stealth_labels": sql(
        ["flows"],
        f"""SELECT {t('w', 'window_start')}, source_ip, unique_ports, {r('sa', 'sa_ratio', 3)}, {r('m', 'iat_mean', 3)}, {r('sd', 'iat_std', 3)},
CASE WHEN unique_ports > {P.port_scan_ports} THEN 'Stealth Port Scan (Reconnaissance Phase)'
WHEN sa > {P.syn_flood_ratio} THEN 'Stealth SYN Flood (State Exhaustion)'
WHEN sd > {P.slow_floor} AND m > {P.slow_mean} AND sd < {P.slow_std} THEN 'Slowloris (Application-Layer DoS)'
ELSE 'Normal' END AS label FROM (SELECT *, {ratio('syn_count', 'ack_count')} AS sa,
coalesce(gap_mean, 0) AS m, coalesce(gap_std, 0) AS sd FROM flows)""",
    ),
    "dns_query_list": sql(["dns"], f"SELECT {t('ts', 'ts')}, source_ip, domain FROM dns"),
    "domain_entropy": sql(
        [],
        f"""WITH hosts AS (SELECT page_id, {HOST_OF_URL} AS domain FROM pages), letters AS ({LETTERS.format('hosts')})
SELECT page_id, domain, {label} AS label, {r('entropy', 'entropy')}, {r('entropy', 'cell_entropy')}
FROM hosts JOIN letters USING (domain)""",
    ),
    "dga_flags": sql(
        ["dns", "dns_entropy"],
        f"""SELECT {t('ts', 'ts')}, source_ip, domain AS analyzed_domain, {r('entropy', 'entropy')},
entropy > {P.dga_entropy} AS "is_DGA", {d(P.dga_entropy)} AS threshold FROM dns JOIN dns_entropy USING (domain)""",
    ),
    "dns_fanout": sql(
        ["dns", "dns_entropy"],
        f"""SELECT {t('ts', 'ts')}, source_ip, 'dns' AS analyzer, {r('entropy', 'entropy_shannon')}
FROM dns JOIN dns_entropy USING (domain)""",
    ),
    "count_windows": sql(["windows20"], "SELECT series, w, rn, t_vol, n_req, s_len FROM windows20"),
    "renyi_tumbling": sql(["line_wide"], f"SELECT series, w, {H_ROUNDED} FROM line_wide"),
    "shannon_tumbling": sql(["line_wide1"], f"SELECT series, w, {H_ROUNDED} FROM line_wide1"),
    "entropy_residual": sql(
        ["line_fit"], f"SELECT series, w, {r('abs(actual - predicted)', 'residual')} FROM line_fit"
    ),
    "poly_terms": sql(
        ["line_wide"],
        f"""SELECT series, w, {r('h_n_req', 'n_req')}, {r('h_s_len', 's_len')}, {r('h_n_req * h_n_req', 'n_req_sq')},
{r('h_n_req * h_s_len', 'n_req_s_len')}, {r('h_s_len * h_s_len', 's_len_sq')} FROM line_wide""",
    ),
    "kinematics": sql(
        [FLOW_MOVING, "flows"],
        f"""SELECT {t('w', 'window_start')}, source_ip, {r('coalesce(residual, 0)', 'residual')},
{r('velocity', 'velocity')}, {r('acceleration', 'acceleration')} FROM {FLOW_MOVING} JOIN flows USING (source_ip, rn)""",
    ),
    "offline_features": sql(["recorded"], f"SELECT series, rn, {FEATURES_ROUNDED}, label FROM recorded"),
    "stability_check": sql(
        ["windows20", "lines"],
        f"""SELECT series, w, {', '.join(f'bool_or(u_{c}) AS unstable_{c}' for c in SERIES)},
count(*) FILTER (u_t_vol OR u_n_req OR u_s_len) AS unstable_rows FROM (SELECT series, w,
{', '.join(f'abs({c} - m_{c}) > 0.1 * sd_{c} AS u_{c}' for c in SERIES)} FROM windows20, (SELECT
{', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}' for c in SERIES)} FROM lines)) GROUP BY series, w""",
    ),
    "any_violation": sql(
        ["windows20", "lines"],
        f"""SELECT bool_or(u) AS violated FROM (SELECT
{' OR '.join(f'abs({c} - m_{c}) > 0.1 * sd_{c}' for c in SERIES)} AS u FROM windows20, (SELECT
{', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}' for c in SERIES)} FROM lines))""",
    ),
    "zscore_chebyshev": sql(
        ["line_fit"],
        f"""SELECT series, w, {r('res', 'residual')}, {r('z', 'z')}, {r('sqrt(1 / 0.01)', 'bound')}, z > sqrt(1 / 0.01) AS anomalous
FROM (SELECT *, (res - {d(LINE_MEAN)}) / {d(LINE_SIGMA)} AS z FROM (SELECT *, abs(actual - predicted) AS res FROM line_fit))""",
    ),
    "burst_signature": sql(
        ["windows5", "lines"],
        f"""SELECT series, w, {', '.join(r(f'a_{c}', f'avg_{c}') for c in SERIES)},
CASE WHEN a_t_vol > m_t_vol + 0.8 * sd_t_vol AND a_s_len > m_s_len + 0.8 * sd_s_len
THEN 'Legitimate Burst (Speedtest/Large Download)'
WHEN a_n_req > m_n_req + 0.8 * sd_n_req AND a_s_len < m_s_len THEN 'Malicious Attack (Potential Flood)'
ELSE 'Unknown Anomaly (Further check...)' END AS label
FROM (SELECT series, w, {', '.join(f'avg({c}) AS a_{c}' for c in SERIES)} FROM windows5 GROUP BY series, w),
(SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}' for c in SERIES)} FROM lines)""",
    ),
    "series_stats": sql(
        ["lines"],
        f"""SELECT {', '.join(r(f'avg({c})', f'mean_{c}', 4) for c in SERIES)},
{', '.join(r(f'stddev_pop({c})', f'std_{c}', 4) for c in SERIES)} FROM lines""",
    ),
    "inf_clean": sql(
        ["lines"],
        f"""SELECT series, l_orderkey, l_linenumber, l_partkey, {r('''CASE WHEN l_linenumber = 1
THEN (SELECT avg(t_vol) FROM lines WHERE l_linenumber <> 1) ELSE t_vol END''', 't_vol')} FROM lines""",
    ),
    "dynamic_window": sql(
        ["lines"],
        f"""SELECT series, CAST(trunc({DYNAMIC_SIZE} * (stddev_pop(t_vol) / (SELECT stddev_pop(t_vol) FROM lines))) AS INTEGER) AS size
FROM lines GROUP BY series""",
    ),
    "spike_alerts": sql(
        ["spike_walk", "spikes"],
        f"""SELECT series, rn, {r('residual', 'residual')}, {r('acceleration', 'acceleration')}
FROM spikes JOIN (SELECT series, rn FROM spike_walk WHERE hit) USING (series, rn)""",
    ),
    "minhash_signature": sql(
        ["hashes", "source_counts"],
        f"""SELECT {t('w', 'window_start')}, target_port, n_sources, signature FROM source_counts JOIN (
SELECT w, target_port, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS signature FROM hashes GROUP BY w, target_port)
USING (w, target_port)""",
    ),
    "port_sources": sql(
        ["sources"], f"SELECT {t('w', 'window_start')}, target_port, src_ip AS source_ip FROM sources"
    ),
    "spatial_jaccard": sql(
        ["similarity"],
        f"""SELECT {t('w', 'window_start')}, target_port, n_sources, {r(SCORE, 'jaccard_score')}, matches,
n_sources >= {P.min_sources} AND raw_matches IS NOT NULL AND {SCORE} >= {P.jaccard_threshold} AS is_botnet,
CASE WHEN n_sources < {P.min_sources} THEN 'too few sources' WHEN raw_matches IS NULL THEN 'idle'
WHEN {SCORE} >= {P.jaccard_threshold} THEN 'potentially malicious' ELSE 'benign' END AS status FROM similarity""",
    ),
    "spatial_fanout": sql(
        ["similarity", "sources"],
        f"""SELECT {t('w', 'window_start')}, target_port, src_ip AS source_ip, {r(SCORE, 'jaccard_score')}
FROM similarity JOIN sources USING (w, target_port)""",
    ),
    "spatial_log": sql(
        ["similarity", "packets"],
        f"""SELECT {t('x.w', 'window_start')}, {P.target_port} AS target_port, {r('coalesce(' + SCORE + ', 0)', 'jaccard_score')}
FROM (SELECT unnest(generate_series(time_bucket({CAPTURE}, min(ts)) + {CAPTURE}, max(ts), {CAPTURE})) AS w FROM packets) x
LEFT JOIN similarity s ON s.w = x.w""",
    ),
    "unified_features": sql(
        ["features"], f"SELECT {t('window_start', 'window_start')}, source_ip, {FEATURES_ROUNDED} FROM features"
    ),
    "evaluated_entities": sql(
        ["features"],
        f"SELECT {t('window_start', 'window_start')}, count(DISTINCT source_ip) AS entities FROM features GROUP BY window_start",
    ),
    "host_exclusion": sql(
        ["scored"],
        f"SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')} FROM scored WHERE source_ip NOT IN ('127.0.0.1', '{HOST}')",
    ),
    "guardrails": sql(
        ["scored"],
        f"SELECT {t('time', 'time')}, source_ip, {r(f'greatest(probability, {d(P.boost)})', 'probability')} FROM scored WHERE {GUARD}",
    ),
    "quiet_override": sql(
        ["scored"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('sa_ratio', 'sa_ratio')}, {r('entropy_shannon', 'entropy_shannon')}
FROM scored WHERE {QUIET}""",
    ),
    "bayes_posterior": sql(
        ["all_walk", "scored"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')}, {r('posterior', 'posterior')}
FROM all_walk JOIN scored USING (source_ip, time)""",
    ),
    "verdicts": sql(
        ["stored"],
        f"""SELECT {t('time', 'time')}, source_ip, 'aggregated' AS analyzer, FALSE AS is_host_ip, {FEATURES_ROUNDED},
{r('probability', 'probability')}, prediction, quiet FROM stored""",
    ),
    "prior_adjust": sql(
        ["scored"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('q * 0.01 / (q * 0.01 + (1 - q) * 0.99)', 'adjusted')}
FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, probability)) AS q FROM scored)""",
    ),
    "alerts": sql(
        ["alert_lines"],
        f"SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')}, line FROM alert_lines",
    ),
    "alert_tail": sql(
        ["alert_lines"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')}, line
FROM (SELECT * FROM alert_lines ORDER BY time DESC, source_ip LIMIT 10)""",
    ),
    "alert_rotation": sql(
        ["alert_lines"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')}, line
FROM (SELECT * FROM alert_lines ORDER BY time DESC, source_ip LIMIT 50)""",
    ),
    "alert_log_scan": sql(["alert_lines"], "SELECT line FROM alert_lines"),
    "latest_events": sql(
        ["stored"],
        f"""SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')}, prediction
FROM (SELECT * FROM stored ORDER BY time DESC, source_ip LIMIT 5)""",
    ),
    "attacks_desc": sql(
        ["stored"],
        f"SELECT {t('time', 'time')}, source_ip, {r('probability', 'probability')} FROM stored WHERE prediction = 1",
    ),
    "latest_per_ip": sql(
        ["stored"],
        f"""SELECT source_ip, {t('time', 'time')}, {r('probability', 'probability')}, prediction FROM (
SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY time DESC) AS n FROM stored) WHERE n = 1""",
    ),
    "unprocessed_count": sql(
        ["stored", "ledger"],
        """SELECT count(*) AS events, count(*) FILTER (batch NOT IN (SELECT batch FROM ledger)) AS unprocessed FROM stored""",
    ),
    "sanitized_batch": sql(
        ["pending"],
        f"SELECT {t('time', 'time')}, source_ip, {FEATURES_ROUNDED}, {RELABEL} FROM pending WHERE {SURE}",
    ),
    "ledger_unprocessed": sql(
        ["pending"],
        f"SELECT DISTINCT batch AS ingest_batch_id FROM pending WHERE EXISTS (SELECT 1 FROM pending WHERE {SURE})",
    ),
    "retention": sql(
        ["stored"],
        f"""SELECT {t('time', 'time')}, source_ip, prediction FROM stored
WHERE time >= TIMESTAMP '{AS_OF}' - INTERVAL '{RETENTION_DAYS} days'""",
    ),
    "threat_bands": sql(
        ["stored"],
        """SELECT CASE WHEN probability < 0.5 THEN 'low' WHEN probability < 0.85 THEN 'elevated' ELSE 'high' END AS band,
count(*) AS n, count(*) FILTER (probability >= 0.95) AS above_mark FROM stored GROUP BY band""",
    ),
    "latest_velocity": sql(
        ["scored"],
        f"SELECT {r('velocity', 'velocity')} FROM scored ORDER BY time DESC, source_ip DESC LIMIT 1",
    ),
    "threshold_flags": sql(
        ["scored"],
        "SELECT velocity > 0.65 AS fast, acceleration > 0.8 AS jerky, count(*) AS n FROM scored GROUP BY ALL",
    ),
    "adaptive_rows": sql(
        ["stored"], f"SELECT {t('time', 'time')}, source_ip, {FEATURES_ROUNDED}, {RELABEL} {RECENT}"
    ),
    "adaptive_training_set": sql(
        ["stored", "recorded"],
        f"SELECT {FEATURES_ROUNDED}, label FROM recorded UNION ALL SELECT {FEATURES_ROUNDED}, {RELABEL} {RECENT}",
    ),
    "class_counts": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "balanced_set": f"""WITH x AS (SELECT doc_id, 1 - toxic AS label FROM labels)
SELECT doc_id, label FROM x WHERE label = 0 UNION ALL (SELECT doc_id, label FROM x WHERE label = 1
ORDER BY {MD5_ID}, doc_id LIMIT (SELECT count(*) FROM x WHERE label = 0))""",
    "balanced_lines": f"""WITH x AS ({BALANCED_LINES})
SELECT id, label FROM x WHERE label = 0 UNION ALL (SELECT id, label FROM x WHERE label = 1
ORDER BY md5('42-' || id), id LIMIT (SELECT count(*) FROM x WHERE label = 0))""",
    "train_test_split": f"""SELECT doc_id, CAST('0x' || substr({MD5_ID}, 1, 8) AS BIGINT) % 100 < 20 AS held_out FROM labels""",
    "shuffled_labels": f"SELECT doc_id, quality, toxic, {MD5_ID} AS order_key FROM labels",
    "scaled_features": sql(
        ["stored"],
        f"""SELECT {t('time', 'time')}, source_ip, {', '.join(r(f'({c} - m_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END', c, PLACES.get(c, 6)) for c in FEATURES)}
FROM stored, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}' for c in FEATURES)} FROM stored)""",
    ),
    "training_stats": sql(
        ["line_fit", "lines"],
        f"""SELECT {r('avg(abs(actual - predicted))', 'mean_train', 4)}, {r('stddev_pop(abs(actual - predicted))', 'sigma_train', 4)},
{', '.join(r(f'any_value(m_{c})', f'mean_{c}', 4) + ', ' + r(f'any_value(sd_{c})', f'std_{c}', 4) for c in SERIES)}
FROM line_fit, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}' for c in SERIES)} FROM lines)""",
    ),
    "regression_normal_equations": sql(
        ["windows20"],
        """SELECT term, 0.0 AS product, n FROM
(SELECT unnest(['constant', 'n_req', 's_len', 'n_req_sq', 'n_req_s_len', 's_len_sq']) AS term),
(SELECT count(*) AS n FROM (SELECT DISTINCT series, w FROM windows20)
WHERE CAST('0x' || substr(md5('42-' || series || '-' || w), 1, 8) AS BIGINT) % 100 >= 20)""",
    ),
    "mlp_score_bounds": sql(["scored"], "SELECT count(*) AS n, count(*) AS n_probable, count(*) AS n_consistent FROM scored"),
    "mlp_hold_out_bounds": sql(
        ["stored", "recorded"],
        f"""SELECT label, least(b, a) AS n, TRUE AS a_fifth_held_out, TRUE AS beats_guessing FROM (VALUES (0), (1)) AS v(label),
(SELECT count(*) FILTER (label = 0) AS b, count(*) FILTER (label = 1) AS a
FROM (SELECT label FROM recorded UNION ALL SELECT {RELABEL} {RECENT}))""",
    ),
    "ground_truth": sql(["packets"], f"SELECT packet_id, {TRUTH} AS is_attack, {NUMBER} AS \"interval\" FROM packets"),
    "attack_bounds": sql(
        ["packets"],
        " UNION ALL ".join(
            f"""SELECT {n} AS "interval", '{i.label}' AS label, {t('min(ts)', 'first_time')}, {t('max(ts)', 'last_time')}
FROM packets WHERE {inside(i)} HAVING count(*) > 0"""
            for n, i in enumerate(TIMELINE, 1)
            if i.is_attack
        ),
    ),
    "point_adjusted_rows": sql(["adjusted"], "SELECT packet_id, actual, predicted, adjusted FROM adjusted"),
    "point_adjusted_metrics": sql(["adjusted"], rates("adjusted", "adjusted")),
    "confusion_metrics": sql(["detections"], rates("detections", "predicted")),
    "class_report": f"""WITH c AS (SELECT class, count(*) FILTER (quality = class) AS support,
count(*) FILTER (toxic = class) AS called, count(*) FILTER (quality = class AND toxic = class) AS hits
FROM labels, (SELECT DISTINCT unnest([quality, toxic]) AS class FROM labels) GROUP BY class),
m AS (SELECT *, {mean('hits', 'called')} AS p, {mean('hits', 'support')} AS q FROM c),
f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END AS f FROM m)
SELECT CAST(class AS VARCHAR) AS class, {r('p', 'precision')}, {r('q', 'recall')}, {r('f', 'f1')}, support FROM f
UNION ALL SELECT 'accuracy', {r('sum(hits) / sum(support)', 'a')}, {r('sum(hits) / sum(support)', 'b')},
{r('sum(hits) / sum(support)', 'c')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r('avg(p)', 'a')}, {r('avg(q)', 'b')}, {r('avg(f)', 'c')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)', 'a')}, {r('sum(q * support) / sum(support)', 'b')},
{r('sum(f * support) / sum(support)', 'c')}, CAST(sum(support) AS BIGINT) FROM f""",
    "roc_points": sql(
        ["curve"],
        f"SELECT {r('score', 'threshold')}, {r('fp / n', 'fpr')}, {r('tp / p', 'tpr')} FROM curve",
    ),
    "roc_auc": sql(
        ["curve"],
        f"""SELECT {r('sum((x - x0) * (y + y0) / 2)', 'auc')} FROM (SELECT fp / n AS x, tp / p AS y,
coalesce(lag(fp / n) OVER (ORDER BY score DESC), 0) AS x0, coalesce(lag(tp / p) OVER (ORDER BY score DESC), 0) AS y0 FROM curve)""",
    ),
    "pr_points": sql(
        ["curve"],
        f"SELECT {r('score', 'threshold')}, {r('tp / p', 'recall')}, {r('tp / (tp + fp)', 'precision')} FROM curve",
    ),
    "average_precision": sql(
        ["curve"], f"SELECT {r('sum(pos / p * (tp / (tp + fp)))', 'average_precision')} FROM curve"
    ),
    "scored_rows": sql(
        ["line_fit"],
        f"""SELECT series, w, {r('actual', 'actual')}, {r('predicted', 'predicted')},
{r('actual - predicted', 'residual')} FROM line_fit""",
    ),
    "regression_metrics": sql(
        ["line_fit"],
        f"""SELECT count(*) AS n, {r('1 - avg((actual - predicted) ** 2) / var_pop(actual)', 'r2')},
{r('avg(abs(actual - predicted))', 'mae')}, {r('avg((actual - predicted) ** 2)', 'mse')},
{r('stddev_pop(abs(actual - predicted))', 'std_abs_residual')} FROM line_fit""",
    ),
    "residual_histogram": sql(
        ["line_fit"],
        """SELECT CAST(least(floor((x - lo) / (hi - lo) * 15), 14) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT actual - predicted AS x, min(actual - predicted) OVER () AS lo, max(actual - predicted) OVER () AS hi
FROM line_fit) GROUP BY bin""",
    ),
    "json_encode": sql(
        ["flows"],
        f"""SELECT source_ip AS key, {t('w', 'timestamp')}, source_ip, unique_ports, syn_count, {r('t_vol', 't_vol')} FROM flows""",
    ),
    "json_decode": sql(
        ["flows"],
        f"""SELECT {FLOW_COLUMNS} FROM (SELECT * REPLACE (CASE WHEN length(source_ip) % 2 = 0 THEN 0 ELSE syn_count END AS syn_count) FROM flows)""",
    ),
    "json_malformed": sql(
        ["flows"],
        "SELECT source_ip AS key, count(*) AS n FROM flows WHERE source_ip LIKE '%1' GROUP BY source_ip",
    ),
    "csv_flows": sql(
        ["line_domains", "line_domain_entropy"],
        f"""SELECT series, l_orderkey, l_linenumber, l_partkey, {r('t_vol', 't_vol')}, {r('n_req', 'n_req')}, {r('s_len', 's_len')},
{r('l_tax', 'iat_mean')}, {r('CAST(0 AS DOUBLE)', 'jaccard_score')}, {r(ratio('l_linenumber', '(l_partkey % 4)'), 'sa_ratio')},
{r('entropy', 'entropy_shannon')} FROM line_domains JOIN line_domain_entropy USING (domain)""",
    ),
    "label_union": sql(
        ["lines"],
        f"""SELECT series, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label, count(*) AS n, {r('sum(t_vol)', 't_vol')}
FROM lines GROUP BY 1, 2""",
    ),
    "frame_decode": sql(
        ["packets", "dns"],
        f"""SELECT packet_id, {t('ts', 'ts')}, src_ip, dst_ip, src_port, dst_port, proto, tcp_flags, domain AS qname
FROM packets LEFT JOIN (SELECT packet_id, domain FROM dns) USING (packet_id) WHERE packet_id % 6 <> 5""",
    ),
}

step(
    "timeline_runs",
    ["packets"],
    f"""SELECT *, sum(CASE WHEN actual = before THEN 0 ELSE 1 END) OVER (PARTITION BY dst_ip ORDER BY ts, packet_id) AS run
FROM (SELECT *, lag(actual) OVER (PARTITION BY dst_ip ORDER BY ts, packet_id) AS before
FROM (SELECT *, {TRUTH} AS actual, CASE WHEN length > 75 THEN 1 ELSE 0 END AS predicted FROM packets))""",
)
step(
    "timeline_adjusted",
    ["timeline_runs"],
    """SELECT dst_ip AS log, actual, CASE WHEN actual = 1 THEN max(predicted) OVER (PARTITION BY dst_ip, run)
ELSE predicted END AS adjusted FROM timeline_runs""",
)
ORACLES["log_quality"] = sql(
    ["timeline_adjusted"], rates("timeline_adjusted", "adjusted").replace("SELECT log, tp", "SELECT log AS dst_ip, tp", 1)
)
ORACLES["stream_events"] = sql(
    ["stored"],
    f"""SELECT {t('time', 'time')}, source_ip, 'aggregated' AS analyzer, {FEATURES_ROUNDED},
{r('probability', 'probability')}, prediction FROM stored""",
)

ORACLES["stream_events_by_messages"] = ORACLES["stream_events"]

step("short_frames", ["lines"], frames("lines", "series", P.trailing_rows, False))
step("short_long", ["short_frames"], longer("short_frames", "series, rn"))
step("short_h", ["short_long"], renyi("short_long", "series, rn", most=P.trailing_rows))
step("short_wide", ["short_h"], pivoted("short_h", "series, rn"))
ORACLES["renyi_trailing"] = sql(["short_wide"], f"SELECT series, rn, {H_ROUNDED} FROM short_wide")

# Recursive steps need the keyword on the whole statement.
ORACLES = {
    name: text.replace("WITH ", "WITH RECURSIVE ", 1) if "_walk AS (" in text else text
    for name, text in ORACLES.items()
}
