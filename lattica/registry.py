"""Queries over the driver tables, by name, with the SQL that gives the same rows.

Nested results are flattened to rows here, so that they can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import crypto
from .functions import values as V
from .operators import admission, index, merge, mutate, reputation, routing, state
from .plans.nested import ALL, Graph, resolve, select
from .sources import log
from .sources import tables as T
from .streaming import merges
from .streaming.paths import fresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _flat(s: DataFrame) -> DataFrame:
    return s.select("soul", "field", F.col("value.num").alias("num"), "ts", "lamport")


EVENT = "'user:' || user_id AS soul, event_type AS field, value AS num, epoch_us(ts) / 1000.0 AS ts, CAST(event_id AS DOUBLE) AS lamport"
DELTA = "CASE event_type WHEN 'view' THEN 1.0 WHEN 'error' THEN -1.0 WHEN 'click' THEN -5.0 WHEN 'signup' THEN -3.0 ELSE 10.0 END::DOUBLE"
PAD = "lpad(CAST({} AS VARCHAR), 10, '0')"


def _soul(kind: str, key: str) -> str:
    return f"'{kind}:' || {PAD.format(key)}"


ITEM = "'item:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))"


# Merging


@query(f"SELECT {EVENT} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def lww_state(spark, d):
    """Last write wins, unguarded."""
    return _flat(merge.lww(T.event_writes(spark, d)))


@query("""SELECT 'user:' || user_id AS soul, event_type AS field, value AS num, CAST(epoch_ms(date_trunc('day', ts)) AS DOUBLE) AS ts, 1.0::DOUBLE AS lamport FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC, value DESC) = 1""")
def lww_tie_break(spark, d):
    """Equal clocks, times of whole days: the greater value wins a tie."""
    day = T.millis(F.date_trunc("day", F.col("ts")))
    return _flat(merge.lww(T.event_writes(spark, d, ts=day, lamport=F.lit(1.0))))


@query(f"SELECT {EVENT} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def fww_state(spark, d):
    return _flat(merge.fww(T.event_writes(spark, d)))


@query("""WITH RECURSIVE w AS (
  SELECT user_id, event_type, value, epoch_us(ts) / 1000000.0 AS ts, CAST(event_id AS DOUBLE) AS lamport, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
f AS (
  SELECT user_id, event_type, value, ts, lamport, k FROM w WHERE k = 1
  UNION ALL
  SELECT w.user_id, w.event_type, CASE WHEN w.ts > f.ts + 300000 THEN f.value ELSE w.value END, CASE WHEN w.ts > f.ts + 300000 THEN f.ts ELSE w.ts END,
         CASE WHEN w.ts > f.ts + 300000 THEN f.lamport ELSE least(w.lamport, f.lamport + 1000) END, w.k
  FROM f JOIN w ON w.user_id = f.user_id AND w.event_type = f.event_type AND w.k = f.k + 1)
SELECT 'user:' || user_id AS soul, event_type AS field, value AS num, ts, lamport FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) = 1""")
def guarded_merge(spark, d):
    """The ordered fold with its guards, times a thousandth so that the ceiling turns away some writes only."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return _flat(merge.folded(T.event_writes(spark, d, ts=ts)))


@query("SELECT 'user:' || user_id AS soul, event_type AS field, max(value) AS num FROM events GROUP BY ALL")
def custom_merge(spark, d):
    """A resolver of one's own: the greater value stays."""
    greater = lambda ts, v, cur_ts, cur, lam, cur_lam: cur is None or v["num"] > cur["num"]
    return merge.folded(T.event_writes(spark, d), greater, ts_jump=float("inf")).select("soul", "field", F.col("value.num").alias("num"))


@query("SELECT CAST(max(event_id) AS DOUBLE) AS clock FROM events")
def replay_clock(spark, d):
    return merge.replay_clock(merge.lww(T.event_writes(spark, d)))


# State


def _order_state(spark, d) -> DataFrame:
    """Orders as fields; those of status F are deleted, the marker is set on those of status O."""
    o = T.table(spark, d, "orders")
    gone = F.col("o_orderstatus") == "F"
    total = F.when(gone, V.null()).otherwise(V.number(F.col("o_totalprice")))
    priority = F.when(gone, V.null()).otherwise(V.string(F.col("o_orderpriority")))
    marker = F.when(F.col("o_orderstatus") == "O", V.value("boolean", boolean=F.lit(True))).otherwise(V.value("boolean", boolean=F.lit(False)))
    fields = F.array(F.struct(F.lit("priority").alias("field"), priority.alias("value")), F.struct(F.lit("total").alias("field"), total.alias("value")))
    with_marker = F.when(gone, fields).otherwise(F.concat(fields, F.array(F.struct(F.lit(state.MARKER).alias("field"), marker.alias("value")))))
    rows = o.select(T.soul("order", F.col("o_orderkey")).alias("soul"), F.explode(with_marker).alias("f"))
    return rows.select("soul", "f.field", "f.value", F.lit(1.0).alias("ts"), F.lit(1.0).alias("lamport"))


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, CAST(3 AS BIGINT) AS fields FROM orders WHERE o_orderstatus <> 'F'")
def tombstone_purge(spark, d):
    return state.purged(_order_state(spark, d)).groupBy("soul").agg(F.count("*").alias("fields"))


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, o_orderpriority AS priority, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def txn_visible(spark, d):
    from pyspark.sql import types as S

    schema = S.StructType([S.StructField("priority", S.StringType()), S.StructField("total", S.DoubleType())])
    return state.wide(state.committed(_order_state(spark, d)), schema).select("soul", "priority", "total")


@query("""SELECT 'user:' || user_id AS soul, count(*) AS fields, max(lamport) AS newest FROM (
  SELECT user_id, event_type, CAST(max(event_id) AS DOUBLE) AS lamport FROM events GROUP BY ALL) GROUP BY user_id""")
def compact_state(spark, d):
    entries = state.compacted(merge.lww(T.event_writes(spark, d)), purge_deleted=True)
    return entries.select("soul", F.size("fields").cast("long").alias("fields"), F.array_max("fields.lamport").alias("newest"))


@query("SELECT count(DISTINCT user_id) AS nodes, count(*) AS fields FROM (SELECT DISTINCT user_id, event_type FROM events)")
def convergence_counts(spark, d):
    return state.counts(merge.lww(T.event_writes(spark, d)))


# Selection queries


@query(f"SELECT {_soul('customer', 'c_custkey')} AS soul, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000")
def root_filter_range(spark, d):
    c = T.customers(spark, d)
    return select(Graph({"customer": c}), "customer", {"souls": ALL, "select": ["name", "acctbal"], "filter": {"acctbal": {"$gte": 1000, "$lt": 5000}}})


@query(f"SELECT {_soul('customer', 'c_custkey')} AS soul, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def root_filter_in(spark, d):
    c = T.customers(spark, d)
    return select(Graph({"customer": c}), "customer", {"souls": ALL, "select": ["name"], "filter": {"segment": {"$in": ["BUILDING", "MACHINERY", 3]}}})


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
def root_filter_ne(spark, d):
    o = T.orders(spark, d)
    return select(Graph({"order": o}), "order", {"souls": ALL, "select": ["total"], "filter": {"status": {"$ne": "F"}, "priority": "1-URGENT"}})


@query(f"SELECT {_soul('part', 'p_partkey')} AS soul, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, soul LIMIT 50 OFFSET 10")
def root_sort_offset_limit(spark, d):
    p = T.table(spark, d, "part").select(T.soul("part", F.col("p_partkey")).alias("soul"), F.col("p_retailprice").alias("price"))
    return select(Graph({"part": p}), "part", {"souls": ALL, "select": ["price"], "sort": ["price", "desc"], "offset": 10, "limit": 50})


@query(f"SELECT p_name AS name FROM part WHERE {_soul('part', 'p_partkey')} IN ('part:0000000007', 'part:0000000003')")
def root_souls_rows(spark, d):
    """Enumerated roots, repeated and missing ones, without their souls."""
    p = T.table(spark, d, "part").select(T.soul("part", F.col("p_partkey")).alias("soul"), F.col("p_name").alias("name"))
    souls = ["part:0000000007", "part:0000000003", "part:0000000007", "part:none"]
    return select(Graph({"part": p}), "part", {"souls": souls, "select": ["name"], "mapToRows": True})


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, o_totalprice AS total, {_soul('customer', 'c_custkey')} AS customer, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def ref_single(spark, d):
    g = T.shop(spark, d)
    out = select(g, "order", {"souls": ALL, "select": ["total"], "buyer": {"via": "customer", "select": ["name"]}})
    return out.select("soul", "total", F.col("buyer.soul").alias("customer"), F.col("buyer.name").alias("name"))


@query(f"""SELECT {_soul('order', 'o_orderkey')} AS soul, {_soul('customer', 'c_custkey')} AS customer, c_acctbal AS acctbal
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000""")
def ref_single_filtered(spark, d):
    """A reference to a node that the filter turns away is null; its parent stays."""
    g = T.shop(spark, d)
    out = select(g, "order", {"souls": ALL, "customer": {"select": ["acctbal"], "filter": {"acctbal": {"$gt": 5000}}}})
    return out.select("soul", F.col("customer.soul").alias("customer"), F.col("customer.acctbal").alias("acctbal"))


@query(f"SELECT {_soul('customer', 'c_custkey')} AS soul, {_soul('order', 'o_orderkey')} AS child, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS place, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey")
def ref_list(spark, d):
    g = T.shop(spark, d)
    out = select(g, "customer", {"souls": ALL, "orders": {"list": True, "select": ["total"]}})
    return out.select("soul", F.posexplode("orders").alias("place", "o")).select("soul", F.col("o.soul").alias("child"), F.col("place").cast("long").alias("place"), F.col("o.total").alias("total"))


@query(f"""SELECT {_soul('customer', 'c_custkey')} AS soul, {_soul('order', 'o_orderkey')} AS child, k - 2 AS place, o_totalprice AS total FROM (
  SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P') WHERE k BETWEEN 2 AND 4""")
def ref_list_topk(spark, d):
    """Filter, order, offset and limit of each list."""
    g = T.shop(spark, d)
    child = {"list": True, "select": ["total"], "filter": {"status": {"$ne": "P"}}, "sort": ["total", "desc"], "offset": 1, "limit": 3}
    out = select(g, "customer", {"souls": ALL, "orders": child})
    return out.select("soul", F.posexplode("orders").alias("place", "o")).select("soul", F.col("o.soul").alias("child"), F.col("place").cast("long").alias("place"), F.col("o.total").alias("total"))


@query(f"""SELECT {_soul('customer', 'c_custkey')} AS soul, {_soul('order', 'o_orderkey')} AS child, {ITEM} AS item, l_quantity AS quantity
FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT * FROM lineitem) ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND c_mktsegment = 'BUILDING'""")
def ref_two_level(spark, d):
    g = T.shop(spark, d)
    lists = {"list": True, "items": {"list": True, "select": ["quantity"], "filter": {"flag": "R"}}}
    out = select(g, "customer", {"souls": ALL, "filter": {"segment": "BUILDING"}, "orders": lists})
    rows = out.select("soul", F.explode("orders").alias("o")).select("soul", F.col("o.soul").alias("child"), F.explode("o.items").alias("i"))
    return rows.select("soul", "child", F.col("i.soul").alias("item"), F.col("i.quantity").alias("quantity"))


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, c_name AS name, true AS cut FROM orders JOIN customer ON c_custkey = o_custkey")
def depth_cut(spark, d):
    """Beyond maxDepth a node is its scalars and a flag."""
    g = T.shop(spark, d)
    buyer = {"select": ["name"], "nation": {"select": ["name"]}}
    out = select(g, "order", {"souls": ALL, "customer": buyer, "maxDepth": 0})
    return out.select("soul", F.col("customer.name").alias("name"), F.col("customer._depthExceeded").alias("cut"))


@query(f"SELECT {_soul('customer', 'c_custkey')} AS soul, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def ref_chain(spark, d):
    g = T.shop(spark, d)
    nation = {"select": ["name"], "region": {"select": ["name"]}}
    out = select(g, "customer", {"souls": ALL, "nation": nation})
    return out.select("soul", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, o_totalprice AS total FROM orders WHERE o_orderkey = 7")
def root_single(spark, d):
    """One root by its soul."""
    return select(T.shop(spark, d), "order", {"soul": "order:0000000007", "select": ["total"]})


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 150000")
def root_empty_condition(spark, d):
    """An empty condition asks for the field alone; several operators of one field all hold."""
    return select(T.shop(spark, d), "order", {"souls": ALL, "filter": {"status": {}, "total": {"$gte": 1000, "$lte": 150000}}})


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def reserved_alias(spark, d):
    """A reserved word is an alias where its value looks like a query."""
    out = select(T.shop(spark, d), "order", {"souls": ALL, "limit": {"via": "customer", "select": ["name"]}})
    return out.select("soul", F.col("limit.name").alias("name"))


@query(f"SELECT {_soul('customer', 'c_custkey')} AS soul, c_name AS name FROM customer WHERE c_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderkey = 7)")
def resolve_ref(spark, d):
    return resolve(T.shop(spark, d), "order", "order:0000000007", "customer").select("soul", "name")


@query(f"""SELECT {_soul('order', 'o_orderkey')} AS soul, CASE WHEN o_orderkey % 2 = 0 THEN {_soul('customer', 'c_custkey')} ELSE {_soul('nation', 'c_nationkey')} END AS target,
  CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE n_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def ref_several_collections(spark, d):
    """A reference that leads to nodes of several collections."""
    nation = T.customers(spark, d).select(F.col("soul").alias("customer"), "nation")
    o = T.orders(spark, d).join(nation, "customer").withColumn("about", F.when(F.substring("soul", -1, 1).cast("int") % 2 == 0, F.col("customer")).otherwise(F.col("nation")))
    g = Graph({"order": o, "customer": T.customers(spark, d), "nation": T.nations(spark, d)}, {("order", "about"): ("customer", "nation")})
    out = select(g, "order", {"souls": ALL, "about": {"select": ["name"]}})
    return out.select("soul", F.col("about.soul").alias("target"), F.col("about.name").alias("name"))


# Logs


def _logged(spark, d) -> str:
    """A log written in two appends, the first writes of each field before the last ones."""
    path = f"{fresh(spark, 'log')}/lines"
    writes = T.event_writes(spark, d)
    log.append(merge.fww(writes), path)
    log.append(merge.lww(writes), path)
    return path


@query(ORACLES["fww_state"])
def log_first_write(spark, d):
    """A log of several files replayed under first write wins: its lines come back in the order they were written."""
    return _flat(log.load(spark, _logged(spark, d), "fww"))


@query("""WITH f AS (SELECT user_id, event_type, min_by(value, event_id) AS a, max_by(value, event_id) AS b, min_by(ts, event_id) AS ta, max_by(ts, event_id) AS tb, min(event_id) AS ka, max(event_id) AS kb FROM events GROUP BY ALL)
SELECT 'user:' || user_id AS soul, event_type AS field, CASE WHEN late THEN a ELSE b END AS num, epoch_us(CASE WHEN late THEN ta ELSE tb END) / 1000.0 AS ts, CAST(CASE WHEN late THEN ka ELSE least(kb, ka + 1000) END AS DOUBLE) AS lamport
FROM (SELECT *, epoch_us(tb) > epoch_us(ta) + 300000000 AS late FROM f)""")
def log_guarded_replay(spark, d):
    """The same log under the default rule: a write that is too far ahead in time is skipped, and a clock's jump is cut."""
    return _flat(log.load(spark, _logged(spark, d)))


@query("SELECT 'user:' || user_id AS soul, event_type AS field, value AS num FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def log_compacted(spark, d):
    """A log rewritten: one line a soul, without the fields that a change drops."""
    path = f"{fresh(spark, 'log')}/lines"
    log.append(merge.lww(T.event_writes(spark, d)), path)
    log.rewrite(spark, path, f"{path}-new", lambda state: state.where("field <> 'error'"))
    return _flat(log.load(spark, f"{path}-new")).select("soul", "field", "num")


@query(f"SELECT user_id AS peer_id, sum({DELTA}) AS delta, count(*) AS entries FROM events GROUP BY user_id")
def ledger_log(spark, d):
    """The reputation log, appended twice and read back."""
    path = f"{fresh(spark, 'ledger')}/lines"
    rows = T.event_ledger(spark, d).withColumn("peer_id", F.col("peer_id").cast("string"))
    log.append_ledger(rows.where("seq % 2 = 0"), path)
    log.append_ledger(rows.where("seq % 2 = 1"), path)
    found = log.load_ledger(spark, path).groupBy("peer_id").agg(F.sum("delta").alias("delta"), F.count("*").alias("entries"))
    return found.select(F.col("peer_id").cast("long").alias("peer_id"), "delta", "entries")


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, unnest(['priority', 'total', '_txnComplete']) AS field, 'null' AS kind, 9.0::DOUBLE AS ts, 8.0::DOUBLE AS lamport FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0")
def delete_nodes(spark, d):
    """Null writes for every field of nodes that live; none for those that are deleted already."""
    souls = T.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(T.soul("order", F.col("o_orderkey")).alias("soul"))
    out = mutate.delete(_order_state(spark, d), souls, 9.0, 7.0)
    return out.select("soul", "field", F.col("value.kind").alias("kind"), "ts", "lamport")


@query("""WITH RECURSIVE w AS (SELECT user_id, event_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 2 = 0 THEN CAST((event_id * 7) % 5000 AS DOUBLE) END AS lamport, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, CAST(0 AS DOUBLE) AS clock, CAST(0 AS BIGINT) AS k FROM (SELECT DISTINCT user_id FROM w) UNION ALL
  SELECT w.user_id, CASE WHEN NOT w.ok THEN f.clock WHEN w.lamport IS NULL THEN f.clock + 1 ELSE greatest(f.clock, least(w.lamport, f.clock + 1000)) + 1 END, w.k FROM f JOIN w ON w.user_id = f.user_id AND w.k = f.k + 1)
SELECT user_id AS node, max_by(clock, k) AS clock FROM f GROUP BY user_id""")
def live_clock(spark, d):
    """The local clock of each node: own writes, others' clocks, and those that were turned away."""
    e = T.table(spark, d, "events")
    lamport = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 7 % 5000).cast("double"))
    return merge.local_clock(e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 != 0).alias("accepted"), lamport.alias("lamport"), F.lit(None).cast("double").alias("by_field")))


# Access by key


@query(f"SELECT {_soul('order', 'o_orderkey')} AS soul, o_totalprice AS total FROM orders WHERE o_orderkey = 7")
def point_get(spark, d):
    return index.point(T.orders(spark, d), "order:0000000007").select("soul", "total")


@query(f"SELECT DISTINCT {_soul('order', 'o_orderkey')} AS soul FROM orders WHERE starts_with({_soul('order', 'o_orderkey')}, 'order:00000001')")
def prefix_scan(spark, d):
    return index.prefix(T.orders(spark, d), "order:00000001")


@query(f"SELECT DISTINCT {_soul('order', 'o_orderkey')} AS soul FROM orders WHERE {_soul('order', 'o_orderkey')} >= 'order:0000000100' AND {_soul('order', 'o_orderkey')} < 'order:0000000900'")
def range_scan(spark, d):
    return index.souls_between(T.orders(spark, d), "order:0000000100", "order:0000000900")


@query("SELECT 'user:' || user_id AS soul, epoch_us(ts) / 1000.0 AS timestamp, event_id AS entry FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def index_newest(spark, d):
    e = T.table(spark, d, "events")
    entries = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("soul"), T.millis(F.col("ts")).alias("timestamp"), F.col("event_id").alias("entry"), F.col("event_id").alias("source"))
    return index.newest(entries).select("soul", "timestamp", "entry")


@query("SELECT 'user:' || user_id AS soul, max(epoch_us(ts) / 1000.0) AS timestamp FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) GROUP BY ALL")
def index_rebuild(spark, d):
    return index.rebuilt(merge.lww(T.event_writes(spark, d)))


# Reputation


SCORED = f"""l AS (SELECT user_id AS peer_id, event_id, {DELTA} AS delta FROM events),
s AS (SELECT peer_id, event_id, sum(delta) OVER (PARTITION BY peer_id ORDER BY event_id) AS x FROM l),
m AS (SELECT peer_id, event_id, x - greatest(0, max(x) OVER (PARTITION BY peer_id ORDER BY event_id) - 20) AS score FROM s)"""


@query(f"""WITH {SCORED}
SELECT peer_id, max_by(score, event_id) AS score, (SELECT least(20, sum(delta)) FROM l WHERE l.peer_id = m.peer_id)::DOUBLE AS restored, count(*) AS entries FROM m GROUP BY peer_id""")
def reputation_score(spark, d):
    return reputation.scores(T.event_ledger(spark, d))


@query(f"""WITH {SCORED}, e AS (SELECT peer_id, max_by(score, event_id) AS score FROM m GROUP BY peer_id)
SELECT peer_id, CASE WHEN score >= 0 THEN 'accept' WHEN score < -10 THEN 'drop' ELSE 'queue' END AS band, score < -20 AS isolated FROM e""")
def throttle_state(spark, d):
    s = reputation.scores(T.event_ledger(spark, d))
    return s.select("peer_id", reputation.throttle(F.col("score")).alias("band"), reputation.isolated(F.col("score")).alias("isolated"))


@query(f"SELECT user_id AS peer_id, sum({DELTA}) AS delta, max_by(event_type, event_id) AS reason, max_by(epoch_us(ts) / 1000.0, event_id) AS ts FROM events GROUP BY user_id")
def reputation_compact(spark, d):
    return reputation.compacted(T.event_ledger(spark, d))


@query("SELECT user_id AS peer_id, event_id AS seq FROM events ORDER BY event_id DESC LIMIT 500")
def ledger_cap(spark, d):
    return reputation.capped_ledger(T.event_ledger(spark, d), 500).select("peer_id", "seq")


@query(f"""WITH e AS (SELECT user_id % 20 AS conn, user_id AS peer_id, greatest(-5, least(10, {DELTA} * 2))::DOUBLE AS delta, event_type AS reason, floor(epoch_us(ts) / 3600000000.0)::DOUBLE AS ts, event_id AS seq FROM events),
o AS (SELECT peer_id, delta, reason, ts, min(seq) AS seq, min_by(conn, seq) AS conn FROM e GROUP BY ALL),
w AS (SELECT *, CAST(floor(ts / 60000) AS BIGINT) AS "window" FROM o),
f AS (SELECT *, min(seq) OVER (PARTITION BY conn, "window", peer_id) AS first, row_number() OVER (PARTITION BY conn, "window", peer_id ORDER BY seq) AS k FROM w),
t AS (SELECT *, dense_rank() OVER (PARTITION BY conn, "window" ORDER BY first) AS t FROM f)
SELECT conn, peer_id, delta, reason, ts, seq FROM t WHERE t <= 3 AND k <= 5""")
def gossip_fold(spark, d):
    """Remote entries: clamped, repeats dropped, capped by connection and window; times in hours so that some repeat."""
    l = T.event_ledger(spark, d)  # noqa: E741
    rows = l.select((F.col("peer_id") % 20).alias("conn"), "peer_id", (F.col("delta") * 2).alias("delta"), "reason", F.floor(F.col("ts") / 3600000).cast("double").alias("ts"), "seq")
    return reputation.gossip(rows, targets=3).select("conn", "peer_id", "delta", "reason", "ts", "seq")


# Admission


@query("""SELECT event_id AS seq, user_id AS conn, clock, clock > coalesce(max(clock) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_order
FROM (SELECT event_id, user_id, CAST((event_id * 37) % 1009 AS DOUBLE) AS clock FROM events)""")
def clock_gate(spark, d):
    e = T.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("conn"), (F.col("event_id") * 37 % 1009).cast("double").alias("clock"))
    return admission.clock_order(rows).select("seq", "conn", "clock", "in_order")


@query("SELECT CAST(event_id % 500 AS VARCHAR) AS id, min(event_id) AS seq, min_by(user_id, event_id) AS conn FROM events GROUP BY ALL")
def dedup_ids(spark, d):
    e = T.table(spark, d, "events")
    rows = e.select((F.col("event_id") % 500).cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("conn"))
    return admission.first_of_id(rows).select("id", "seq", "conn")


@query("""SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'parse' WHEN event_id % 13 = 0 THEN 'envelope' WHEN event_id % 7 = 0 THEN 'signature_missing' ELSE 'in' END AS gate FROM events""")
def stateless_gates(spark, d):
    """Torn JSON, ids that are too long, writes to keys without a signature."""
    e = T.table(spark, d, "events")
    soul = F.when(F.col("event_id") % 7 == 0, F.sha2(F.col("event_id").cast("string"), 256)).otherwise("plain")
    ident = F.when(F.col("event_id") % 13 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("event_id").cast("string"))
    raw = F.to_json(F.struct(ident.alias("id"), F.lit("put").alias("type"), soul.alias("soul")))
    raw = F.when(F.col("event_id") % 11 == 0, F.substring(raw, 1, 9)).otherwise(raw)
    rows = admission.gated(admission.parsed(e.select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), raw.alias("raw"))))
    return rows.select("seq", F.coalesce("reject", F.lit("in")).alias("gate"))


ADMITTED = f"""m AS (SELECT event_id AS seq, user_id AS conn, CAST(event_id - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS id, event_type = 'view' AS put, CAST((event_id * 37) % 1009 AS DOUBLE) AS clock, event_id % 10 = 0 AS unfinite FROM events),
l AS (SELECT user_id AS peer, least(20, sum({DELTA})) AS score FROM events GROUP BY user_id),
r AS (SELECT *, CASE WHEN seq % 11 = 0 THEN 'parse' WHEN nth > 1 THEN 'repeat' WHEN score < -10 THEN 'throttled' WHEN unfinite THEN 'clock' END AS early FROM
  (SELECT m.*, score, row_number() OVER (PARTITION BY CASE WHEN m.seq % 11 = 0 THEN 'x' || m.seq ELSE id END ORDER BY m.seq) AS nth FROM m JOIN l ON peer = conn)),
c AS (SELECT *, coalesce(early, CASE WHEN clock <= coalesce(max(CASE WHEN early IS NULL THEN clock END) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'clock_order' END) AS reject FROM r)"""


@query(f"""WITH {ADMITTED}
SELECT seq, outcome, CASE WHEN outcome = 'accept' AND put OR outcome IN ('parse', 'clock', 'clock_order') THEN CAST(conn AS VARCHAR) END AS peer,
  CASE WHEN outcome = 'accept' AND put THEN 1.0 WHEN outcome IN ('parse', 'clock') THEN -1.0 WHEN outcome = 'clock_order' THEN -5.0 END::DOUBLE AS delta
FROM (SELECT *, coalesce(reject, CASE WHEN score >= 0 THEN 'accept' ELSE 'queue' END) AS outcome FROM c)""")
def admission_chain(spark, d):
    """Every gate in turn, throttling and the ledger entries that messages add: torn JSON, repeated ids, clocks that are no numbers or don't rise."""
    e, k = T.table(spark, d, "events"), F.col("event_id")
    ident = (k - F.when(k % 4 == 0, 1).otherwise(0)).cast("string")
    clock = F.when(k % 10 == 0, F.lit('"x"')).otherwise((k * 37 % 1009).cast("string"))
    raw = F.concat(F.lit('{"id":"'), ident, F.lit('","type":"'), F.when(F.col("event_type") == "view", "put").otherwise("get"), F.lit('","soul":"s","fields":{},"lamportClock":'), clock, F.lit("}"))
    raw = F.when(k % 11 == 0, F.substring(raw, 1, 9)).otherwise(raw)
    scores = reputation.compacted(T.event_ledger(spark, d)).select("peer_id", F.least(F.lit(reputation.CAP), "delta").alias("score"))
    return admission.admitted(e.select(F.col("user_id").alias("conn"), k.alias("seq"), raw.alias("raw")), scores).select("seq", "outcome", "peer", "delta")


@query("SELECT CAST(e AS VARCHAR) AS id, conn, 10.0::DOUBLE AS delta FROM (SELECT event_id % 700 AS e, min_by(user_id, event_id) AS conn FROM events WHERE event_id % 700 < 300 AND event_id % 5 < 3 AND user_id % 4 <> (event_id % 700) % 4 GROUP BY ALL)")
def routing_help(spark, d):
    """Who brought own messages back first by another way: messages under 300 are own, the body is right for three of five, and each was sent to a quarter of the connections."""
    k = F.col("event_id")
    e = T.table(spark, d, "events").select(F.col("user_id").alias("conn"), k.alias("seq"), (k % 700).alias("n"), F.when(k % 5 < 3, "body").otherwise("other").alias("digest"))
    ids = e.select("n").distinct().where("n < 300")
    targets = ids.join(e.select("conn").distinct(), F.col("conn") % 4 == F.col("n") % 4).select(F.col("n").cast("string").alias("id"), "conn")
    rows = e.select("conn", "seq", F.col("n").cast("string").alias("id"), "digest")
    return admission.routing_help(rows, ids.select(F.col("n").cast("string").alias("id"), F.lit("body").alias("digest")), targets).select("id", "conn", "delta")


@query(f"""WITH l AS (SELECT user_id AS peer, least(20, sum({DELTA})) AS score FROM events GROUP BY user_id)
SELECT event_id AS seq, CASE WHEN coalesce(score, 0) >= 0 THEN 'accept' WHEN score < -10 THEN 'drop' ELSE 'queue' END AS band FROM events LEFT JOIN l ON peer = CASE WHEN event_id % 2 = 0 THEN user_id + 1 ELSE user_id END""")
def sender_throttle(spark, d):
    """The band of each message: of its sender where that is verified, else of its connection."""
    e = T.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("conn"), (F.col("user_id") + 1).cast("string").alias("sender"))
    scores = reputation.compacted(T.event_ledger(spark, d)).select("peer_id", F.least(F.lit(reputation.CAP), "delta").alias("score"))
    return admission.throttled(e, scores, F.col("seq") % 2 == 0).select("seq", "band")


@query("""SELECT o_orderkey AS k, sha256('{"fields":{"p":"' || o_orderpriority || '","s":"' || o_orderstatus || '"},"ts":' || o_orderkey || '}') AS digest,
  starts_with(sha256('order:' || o_orderkey || ':m:' || sha256('{"fields":{"p":"' || o_orderpriority || '","s":"' || o_orderstatus || '"},"ts":' || o_orderkey || '}') || ':' || o_custkey), '0') AS done FROM orders""")
def pow_verify(spark, d):
    """Proof of work over the canonical JSON of fields and time."""
    o = T.table(spark, d, "orders")
    fields = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")))
    key = F.col("o_orderkey").cast("string")
    rows = o.select(key.alias("key"), "o_orderkey", "o_custkey", crypto.work_digest(fields, key).alias("digest"))
    hashed = crypto.work_hash(F.concat(F.lit("order:"), F.col("key")), F.lit("m"), F.col("digest"), F.col("o_custkey"))
    return rows.select(F.col("o_orderkey").alias("k"), "digest", crypto.work_done(hashed, 1).alias("done"))


@query("""SELECT o_orderkey AS k, substr(sha256('{"a":' || o_orderkey || ',"b":"' || o_orderstatus || '"}'), 1, 16) AS nonce FROM orders""")
def batch_id(spark, d):
    """Equal fields have equal batch ids, whatever the order of their keys."""
    o = T.table(spark, d, "orders")
    fields = F.to_json(F.struct(F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("a")))
    return o.select(F.col("o_orderkey").alias("k"), crypto.batch_nonce(fields).alias("nonce"))


@query("SELECT o_orderkey AS k, rtrim(translate(to_base64(encode(o_orderpriority)), '+/', '-_'), '=') AS code FROM orders")
def base64url_codes(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), crypto.base64url(F.encode("o_orderpriority", "utf-8")).alias("code"))


# Routing and metrics


@query("SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 4) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def geohash_bucket(spark, d):
    o = T.table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("soul"))
    return o.groupBy(routing.bucket(F.col("soul")).alias("bucket")).agg(F.count("*").alias("n"))


PEERS = "SELECT CAST(s_suppkey AS VARCHAR) AS peer, s_acctbal AS latency, CAST(s_suppkey % 3 AS DOUBLE) AS loss, CASE WHEN s_suppkey % 50 = 0 THEN NULL ELSE substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 3) END AS routing_key FROM supplier"


@query(f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY latency - 100 * loss, peer) AS place FROM ({PEERS})),
s AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'plain:' || c_custkey ELSE sha256(CAST(c_custkey AS VARCHAR)) END AS soul, c_custkey % 5 <> 0 AS keyed FROM customer),
m AS (SELECT soul, peer, row_number() OVER (PARTITION BY soul ORDER BY place) AS k FROM s JOIN p ON keyed AND (routing_key IS NULL OR starts_with(routing_key, substr(soul, 1, 2)))),
t AS (SELECT soul FROM m WHERE k <= 6 GROUP BY soul HAVING count(*) >= 3)
SELECT soul, peer FROM m JOIN t USING (soul) WHERE k <= 6
UNION SELECT soul, peer FROM s JOIN p ON place <= 8 WHERE keyed AND (place > 6 OR soul NOT IN (SELECT soul FROM t))
UNION SELECT soul, peer FROM s, p WHERE NOT keyed""")
def route_peers(spark, d):
    """The peers of each write, of every customer; buckets have two hex digits here, so that some are thin and some have members."""
    return _routes(spark, d, 2, 6, 50)


@query()
def route_all_peers(spark, d):
    """The peers of each write, of every customer."""
    return _routes(spark, d, 1)


def _routes(spark, d, n: int, k: int = 3, free: int = 10) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    digits = F.when(F.col("s_suppkey") % free != 0, F.substring(F.sha2(key, 256), 1, n + 1))
    peers = T.table(spark, d, "supplier").select(key.alias("peer"), F.col("s_acctbal").alias("latency"), (F.col("s_suppkey") % 3).cast("double").alias("loss"), digits.alias("routing_key"))
    name = F.col("c_custkey").cast("string")
    souls = T.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("plain:"), name)).otherwise(F.sha2(name, 256)).alias("soul"))
    return routing.routes(souls, peers, k, n=n)


@query("""WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS peer, CASE WHEN s_suppkey % 9 <> 0 THEN substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 4) END AS rk FROM supplier),
m AS (SELECT o_orderkey AS id, o_orderkey % 8 AS hops, CAST(1 + o_orderkey % 10 AS VARCHAR) AS conn, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 4) AS b FROM orders),
s AS (SELECT id, hops, peer, CASE WHEN rk IS NULL THEN 0 WHEN rk = b THEN 4 WHEN substr(rk, 1, 3) = substr(b, 1, 3) THEN 3 WHEN substr(rk, 1, 2) = substr(b, 1, 2) THEN 2 WHEN substr(rk, 1, 1) = substr(b, 1, 1) THEN 1 ELSE 0 END AS shared FROM m JOIN p ON peer <> conn),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, peer) AS k FROM s)
SELECT id, peer, CAST(hops + 1 AS INTEGER) AS hops FROM r WHERE hops < 6 AND k <= 3 UNION ALL SELECT id, peer, CAST(hops AS INTEGER) FROM r WHERE hops >= 6""")
def multi_hop(spark, d):
    """Where each message goes on to: the peers nearest to its bucket, or once its hops are used up every peer but the one it came from."""
    key, k = F.col("s_suppkey").cast("string"), F.col("o_orderkey")
    peers = T.table(spark, d, "supplier").select(key.alias("peer"), F.when(F.col("s_suppkey") % 9 != 0, F.substring(F.sha2(key, 256), 1, 4)).alias("routing_key"))
    messages = T.table(spark, d, "orders").select(k.alias("id"), F.sha2(k.cast("string"), 256).alias("soul"), (k % 8).alias("hops"), (1 + k % 10).cast("string").alias("conn"))
    return routing.next_hops(messages, peers).select("id", "peer", "hops")


@query("""SELECT user_id AS peer, event_id AS seq, (SELECT count(*) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND epoch_ms(p.ts) BETWEEN epoch_ms(e.ts) - 3600000 AND epoch_ms(e.ts)) AS n FROM events e WHERE event_type = 'error'""")
def put_rates(spark, d):
    """Views of the hour before each error of a user: the sliding window that difficulty follows."""
    e = T.table(spark, d, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), F.floor(T.millis(F.col("ts"))).cast("long").alias("ts"), "event_type")
    return routing.rates(e.where("event_type = 'view'"), e.where("event_type = 'error'"), 3_600_000).select("peer", "seq", "n")


@query("""SELECT event_type, max(CASE WHEN k = greatest(1, ceil(0.5 * n)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, ceil(0.9 * n)) THEN value END) AS p90, max(CASE WHEN k = greatest(1, ceil(0.99 * n)) THEN value END) AS p99
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def percentiles(spark, d):
    return routing.percentile(T.table(spark, d, "events"), ["event_type"], "value", [50, 90, 99])


def _samples(spark, d) -> DataFrame:
    return T.table(spark, d, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), F.col("value").alias("latency"))


@query("""WITH r AS (SELECT user_id AS peer, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events),
w AS (SELECT peer, value, row_number() OVER (PARTITION BY peer ORDER BY value) AS k, count(*) OVER (PARTITION BY peer) AS n FROM r WHERE k <= 20)
SELECT peer, max(CASE WHEN k = greatest(1, ceil(0.5 * n)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, ceil(0.9 * n)) THEN value END) AS p90, max(CASE WHEN k = greatest(1, ceil(0.99 * n)) THEN value END) AS p99, max(n) AS samples FROM w GROUP BY peer""")
def latency_metrics(spark, d):
    return routing.metrics(_samples(spark, d), last=20)


@query("""WITH RECURSIVE w AS (SELECT user_id AS peer, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT peer, (0 * 0 + v) / 1 AS x, k FROM w WHERE k = 1 UNION ALL
  SELECT w.peer, (f.x * least(f.k, 100) + w.v) / (least(f.k, 100) + 1), w.k FROM f JOIN w ON w.peer = f.peer AND w.k = f.k + 1)
SELECT peer, round(max_by(x, k), 6) AS latency FROM f GROUP BY peer""")
def peer_health(spark, d):
    return routing.health(_samples(spark, d), "latency").select("peer", F.round("latency", 6).alias("latency"))


@query("""WITH RECURSIVE w AS (SELECT user_id AS peer, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT peer, CAST(1.0 AS DOUBLE) AS x, CAST(0 AS BIGINT) AS k FROM w WHERE k = 1 UNION ALL
  SELECT w.peer, CASE WHEN w.v > 100 THEN greatest(0.1, f.x * 0.9) WHEN w.v < 50 THEN least(1.0, f.x * 1.05) ELSE f.x END, w.k FROM f JOIN w ON w.peer = f.peer AND w.k = f.k + 1)
SELECT peer, round(max_by(x, k), 6) AS scale FROM f GROUP BY peer""")
def backpressure_scale(spark, d):
    ticks = _samples(spark, d).withColumnRenamed("latency", "p99")
    return routing.backpressure(ticks).select("peer", F.round("scale", 6).alias("scale"))


@query("""WITH RECURSIVE w AS (SELECT user_id AS peer, CAST(floor(value) AS INTEGER) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT peer, 4 AS d, CAST(0 AS BIGINT) AS k FROM w WHERE k = 1 UNION ALL
  SELECT w.peer, CASE WHEN w.n > 50 THEN least(8, f.d + 1) WHEN w.n < 5 THEN greatest(1, f.d - 1) ELSE f.d END, w.k FROM f JOIN w ON w.peer = f.peer AND w.k = f.k + 1)
SELECT peer, max_by(d, k) AS difficulty FROM f GROUP BY peer""")
def adaptive_difficulty(spark, d):
    return routing.difficulty(_samples(spark, d).select("peer", "seq", F.floor("latency").alias("n")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS peer, row_number() OVER (ORDER BY s_acctbal - 100 * (s_suppkey % 3), CAST(s_suppkey AS VARCHAR)) AS place FROM supplier ORDER BY place LIMIT 10")
def health_ranking(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("peer"), routing.health_rank(F.col("s_acctbal"), F.col("s_suppkey") % 3).alias("rank"))
    best = s.orderBy("rank", "peer").limit(10)
    return best.select("peer", F.row_number().over(Window.orderBy("rank", "peer")).cast("long").alias("place"))


# Streams


@query(ORACLES["lww_state"])
def stream_merge(spark, d):
    """The log as a stream: its change feed is stored, and the last change of each field is the state."""
    rows = spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/events.parq*et")
    stream = T.event_writes(spark, d, events=rows)
    path = fresh(spark, "feed")
    merges.persisted(merges.merged_stream(stream, ts_jump=float("inf"), lamport_jump=float("inf")), f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return _flat(merges.latest(spark.read.schema(merges.FEED).parquet(f"{path}/log")))
