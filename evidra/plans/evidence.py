"""Queries over the entity graph: checks, traversals, merging, salience."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import check, graph, merge, salience
from ..sources import store as T
from .prelude import quantise, sql, tokens
from .registry import query

SUPPORT_PAIRS = "pairs as (select distinct src, dst from edges where kind in ('deps','grounds'))"
CUSTOMERS = "uid like 'c:%'"

WEAKEST = """weakest as (select src uid, min({'s': u.status, 'g': u.uid}) w from (select distinct src, dst from edges where kind='grounds') g join units u on u.uid = g.dst group by src)"""
CEILING = "ceilings as (select uid, max(case when op='imported' then 5 when rung='computed' then 3 when rung='model' then 2 else 4 end) ceiling from attestations group by uid)"
OPENER = "coalesce(" + ", ".join(f"case when starts_with(lower(trim(gist))||' ', '{o}') then '{o.strip()}' end" for o in S.DANGLING_OPENERS) + ")"
SHAPE_SQL = f"""shape as (
  select 'E021' code, uid, '' detail from units where length(trim(coalesce(gist,'')))=0
  union all select 'E022', uid, cast({tokens('gist')} as varchar) from units where {tokens('gist')} > 30
  union all select 'E031', uid, '' from units where status in (2,3) and uid not in (select src from edges where kind='grounds')
  union all select 'E032', uid, '' from units where status in (4,5) and source is null
  union all select 'E034', uid, '' from units where status = 0)"""
PARAS = "len(list_filter(string_split({b}, chr(10)||chr(10)), lambda x: length(trim(x))>0))"
ITEMS = "len(list_filter(string_split({b}, chr(10)), lambda x: regexp_matches(ltrim(x), '^([-*] |[0-9]+\\. )')))"
GRAN_SQL = f"""gran as (
  select 'W041' code, uid, cast({tokens('body')} as varchar) detail from docs where body is not null and ({tokens('body')} < 40 or {tokens('body')} > 120)
  union all select 'E040', uid, cast({PARAS.format(b='body')} as varchar) from docs where body is not null and ({PARAS.format(b='body')} > 1 or {ITEMS.format(b='body')} > 1))"""
OPEN_SQL = f"openers as (select 'W024' code, uid, opener detail from (select uid, {OPENER} opener from docs where body is not null) where opener is not null)"
KEPT = "uid not like 'p:%' or cast(substring(uid,3) as bigint) % 97 <> 0"
ALL_SQL = f"""found as (
  select 'E030' code, u.uid, w.g detail from units u join weakest k on k.uid=u.uid where status in (2,3) and status > w.s
  union all select 'E033', u.uid, cast(ceiling as varchar) from units u join ceilings c on c.uid=u.uid where status > ceiling
  union all select 'W035', uid, '' from units where status=5 and uid not in (select uid from attestations where op='imported')
  union all select distinct 'E060', src, dst from edges where dst not in (select uid from units where {KEPT})
  union all select * from shape union all select * from gran union all select * from openers)"""


def support(spark, d):
    return T.edges(spark, d, ("grounds", "deps"))


@query(sql("select u.uid, status, w.g ground, w.s ground_status from units u join weakest k on k.uid = u.uid where status in (2,3) and status > w.s", WEAKEST, kinds=('grounds',)))
def check_rule_m(spark, d):
    return check.rule_m(T.units(spark, d), T.edges(spark, d, ("grounds",)))


@query(sql("select u.uid, 5 status, ceiling from units u join ceilings c on c.uid=u.uid where 5 > ceiling", CEILING.replace("from attestations", "from attestations where op <> 'imported'")))
def check_rule_t(spark, d):
    """All customers as if measured, against the attestations that import nothing."""
    return check.rule_t(T.units(spark, d).withColumn("status", F.lit(5)), T.attestations(spark, d).where("op <> 'imported'"))


@query(sql("select uid from units where status=5 and uid not in (select uid from attestations where op='imported')"))
def check_w035(spark, d):
    return check.measured_not_imported(T.units(spark, d), T.attestations(spark, d))


@query(sql("select * from shape", SHAPE_SQL, kinds=('grounds',)))
def check_shape(spark, d):
    return check.shape(T.units(spark, d), T.edges(spark, d, ("grounds",)))


@query(sql("select * from gran", GRAN_SQL))
def check_granularity(spark, d):
    return check.granularity(T.documents(spark, d))


@query(sql("select * from openers", OPEN_SQL))
def check_gist_opener(spark, d):
    return check.gist_openers(T.documents(spark, d))


def some_missing(spark, d):
    """The units without every 97th part, so that references dangle."""
    return T.units(spark, d).where(~F.col("uid").startswith("p:") | (F.substring("uid", 3, 20).try_cast("long") % 97 != 0))


@query(sql(f"select distinct src uid, dst missing from edges where dst not in (select uid from units where {KEPT})"))
def check_dangling(spark, d):
    return graph.dangling(T.edges(spark, d), some_missing(spark, d))


CYCLE = """pairs as (select distinct src, dst from edges where kind in ('causes','sequences')),
reach(a, b) as (select src, dst from pairs union select a, dst from reach join pairs on b = src),
on_cycle as (select distinct a n from reach where a = b)"""


@query(sql("select n uid, true on_path from on_cycle union select a, a in (select n from on_cycle) or a in (select b from reach where a in (select n from on_cycle)) from reach where b in (select n from on_cycle)", CYCLE, kinds=('causes', 'sequences')))
def check_causal_cycles(spark, d):
    return graph.cycles(T.edges(spark, d, ("causes", "sequences")), ("causes", "sequences"))


@query(sql("""select uid, head, count(*) over (partition by head) n from (select r.a uid, min(r.b) head from reach r join reach s on r.a = s.b and r.b = s.a group by r.a
  union all select distinct a, a from reach where b in (select n from on_cycle) and a not in (select n from on_cycle))""", CYCLE, kinds=("causes", "sequences")))
def cycle_groups(spark, d):
    """Which units go round together: those of a group reach each other; the others only lead into one."""
    return graph.cycle_groups(T.edges(spark, d, ("causes", "sequences")), ("causes", "sequences"))


LOOPED = "pairs as (select distinct src, dst from (select src, dst from edges union all select 'n:'||n_nationkey, 's:'||s_suppkey from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 11 = 0))"


@query(sql("select n uid, true on_path from on_cycle union select a, a in (select n from on_cycle) or a in (select b from reach where a in (select n from on_cycle)) from reach where b in (select n from on_cycle)", LOOPED, CYCLE.split(",", 1)[1].split("\n", 1)[1], kinds=("grounds", "deps")))
def check_support_cycles(spark, d):
    """With every eleventh supplier also needed by its own nation, so that support runs in circles."""
    back = T.table(spark, d, "supplier").where("s_suppkey % 11 = 0").select(T.node("n", "s_nationkey").alias("src"), T.node("s", "s_suppkey").alias("dst"), F.lit("deps").alias("kind"))
    return graph.cycles(support(spark, d).union(back), graph.SUPPORT)


def every_finding(spark, d):
    """The findings of all passes."""
    edges = T.edges(spark, d)
    return check.union(*[x for x in (
        check.rows(check.rule_m(T.units(spark, d), edges), "E030", F.col("ground")), check.rows(check.rule_t(T.units(spark, d), T.attestations(spark, d)), "E033", F.col("ceiling")),
        check.rows(check.measured_not_imported(T.units(spark, d), T.attestations(spark, d)), "W035"), check.rows(graph.dangling(edges, some_missing(spark, d)), "E060", F.col("missing")),
        check.shape(T.units(spark, d), edges), check.granularity(T.documents(spark, d)), check.gist_openers(T.documents(spark, d)),
    )])


@query(sql("select code, case when code like 'E%' then 'error' else 'warn' end severity, count(*) n, count(distinct uid) units from found group by code", WEAKEST, CEILING, SHAPE_SQL, GRAN_SQL, OPEN_SQL, ALL_SQL))
def diagnostics_summary(spark, d):
    return check.summary(every_finding(spark, d))


CLASS_ROWS = "classes(class, code) as (values " + ", ".join(f"('{c}','{code}')" for c, codes in check.CLASSES.items() for code in codes) + ")"


@query(sql("select class, count(f.code) = 0 conforms, count(f.code) n_codes from classes c left join (select distinct code from shape union select code from gran) f on f.code = c.code group by class", SHAPE_SQL, GRAN_SQL, CLASS_ROWS, kinds=('grounds',)))
def conformance_verdict(spark, d):
    return check.conformance(check.union(check.shape(T.units(spark, d), T.edges(spark, d, ("grounds",))), check.granularity(T.documents(spark, d))))


@query(sql("select class, count(f.code) = 0 conforms, count(f.code) n_codes from classes c left join (select distinct code from found) f on f.code = c.code group by class", WEAKEST, CEILING, SHAPE_SQL, GRAN_SQL, OPEN_SQL, ALL_SQL, CLASS_ROWS))
def conformance_all(spark, d):
    """The classes against the findings of every pass."""
    return check.conformance(every_finding(spark, d))


@query(sql("select coalesce(u.kind, v.kind) kind, coalesce(n, 0) n, coalesce(views, 0) views from (select kind, count(*) n from units group by kind) u full join (select kind, count(distinct view) as views from asked_ group by kind) v using (kind) where coalesce(u.kind, v.kind) not in ('claim', 'finding', 'evidence')", "asked_ as (select 'v:'||r_regionkey as view, unnest(['data', 'claim', 'x:'||(r_regionkey % 2)]) kind from region)"))
def fidelity_missing(spark, d):
    """What a consumer of three kinds lacks of the units and of what views, one a region, require."""
    views = T.table(spark, d, "region").select(T.node("v", "r_regionkey").alias("view"), F.array(F.lit("data"), F.lit("claim"), F.concat(F.lit("x:"), (F.col("r_regionkey") % 2).cast("string"))).alias("requires"))
    return check.missing(T.units(spark, d), views, ("claim", "finding", "evidence"))


@query(sql("select kind, count(*) n, case when kind in ('claim','finding','evidence') then 'full' when kind in ('data') then 'refuse' else 'degraded' end verdict from units group by kind"))
def fidelity(spark, d):
    return check.fidelity(T.units(spark, d), ("claim", "finding", "evidence"), ("data",))


@query(sql("select distinct 'W013' code, kind uid, '' detail from edges where kind not in ('grounds','deps','rebuts','retracts','supersedes','causes')"))
def check_undeclared_kinds(spark, d):
    return check.undeclared_kinds(T.edges(spark, d), ("grounds", "deps", "rebuts", "retracts", "supersedes", "causes"))


# Traversals


def customers(spark, d):
    return T.units(spark, d).where(F.col("kind") == "claim").select("uid")


REACH = """walk(uid, level) as (select uid, 0 from units where {roots} union select {next}, level+1 from walk join pairs on {at} = walk.uid),
reached as (select uid, min(level) level from walk group by uid)"""


@query(sql("select uid, level from reached", SUPPORT_PAIRS, REACH.format(roots=CUSTOMERS, next="dst", at="src"), kinds=('grounds', 'deps')))
def closure_forward(spark, d):
    return graph.closure(support(spark, d), customers(spark, d))


@query(sql("select uid, level from reached", SUPPORT_PAIRS, REACH.format(roots="uid like 's:%'", next="src", at="dst"), kinds=('grounds', 'deps')))
def closure_reverse(spark, d):
    return graph.closure(support(spark, d), T.units(spark, d).where("kind = 'observation'"), reverse=True)


@query(sql("select uid from walk join units using (uid)", "pairs as (select distinct src, dst from edges)", f"walk(uid) as (select uid from units where {CUSTOMERS} union select dst from walk join pairs on src = walk.uid)"))
def membership(spark, d):
    """Units that customers reach over edges of every kind."""
    return graph.closure(T.edges(spark, d), customers(spark, d), None, units=T.units(spark, d)).select("uid")


@query(sql("select uid, min(level) level from walk join units using (uid) group by uid", "pairs as (select distinct src, dst from edges)", "walk(uid, level) as (select uid, 0 from units where kind = 'data' and try_cast(substring(uid, 3) as bigint) % 50 = 0 union select dst, level + 1 from walk join pairs on src = walk.uid where level < 3)"))
def membership_all(spark, d):
    """Units within three steps of every fiftieth part over edges of every kind."""
    roots = T.units(spark, d).where("kind = 'data'").where(F.substring("uid", 3, 20).try_cast("long") % 50 == 0).select("uid")
    return graph.closure(T.edges(spark, d), roots, None, most=3, units=T.units(spark, d))


WHO = "who as (select uid, string_agg(distinct agent, ',' order by agent) agents, min(hop) hop from attestations group by uid)"


def _trace_sql(ways: str) -> str:
    return f"""ways as (select distinct src, dst, kind, rank from ({ways})),
walk(uid, level) as (select uid, 0 from units where {CUSTOMERS} union select dst, level + 1 from walk join ways on src = walk.uid),
reached as (select uid, min(level) level from walk group by uid),
vias as (select r.uid, arg_min(w.kind, {{'s': w.src, 'r': w.rank}}) via from reached r join ways w on w.dst = r.uid join reached q on q.uid = w.src and q.level = r.level - 1 group by r.uid)"""


TRACED = "select r.uid, r.level, coalesce(via, 'root') via, agents, hop from reached r left join vias v on v.uid = r.uid left join who w on w.uid = r.uid"
GROUNDS_WAYS = "select src, dst, kind, case kind when 'grounds' then 2 else 3 end rank from edges where kind in ('grounds', 'deps')"
PARENT_WAYS = "select uid src, parent dst, 'parent' kind, 0 rank from attestations where parent is not null union all select 'c:'||c_custkey, 'c:'||(c_custkey - 7), 'supersedes', 1 from customer where c_custkey % 3 <> 0"


@query(sql(TRACED, WHO, _trace_sql(GROUNDS_WAYS), kinds=("grounds", "deps")))
def trace_grounds(spark, d):
    return graph.trace(support(spark, d), customers(spark, d), T.attestations(spark, d))


@query(sql(TRACED, WHO, _trace_sql(PARENT_WAYS).replace(CUSTOMERS, "uid like 'c:%' and cast(substring(uid, 3) as bigint) % 5 = 0")))
def trace_parents(spark, d):
    """From every fifth customer to what its attestations and supersession came from."""
    roots = customers(spark, d).where(F.substring("uid", 3, 20).cast("long") % 5 == 0)
    return graph.trace(customer_edges(spark, d), roots, T.attestations(spark, d), "parents")


@query(sql(TRACED, WHO, _trace_sql(GROUNDS_WAYS + " union all " + PARENT_WAYS), kinds=("grounds", "deps")))
def trace_both(spark, d):
    return graph.trace(support(spark, d).unionByName(customer_edges(spark, d)), customers(spark, d), T.attestations(spark, d), "both")


@query(sql("select distinct e.dst uid, e.src neighbour from edges e where kind = 'rebuts' and dst in (select uid from units where kind = 'finding')", kinds=("rebuts",)))
def rebuttals_of(spark, d):
    return graph.neighbours(T.edges(spark, d, ("rebuts",)), T.units(spark, d).where("kind = 'finding'"), ("rebuts",), incoming=True)


@query(sql("select uid, row_number() over (order by coalesce(high, uid), coalesce(place, 0)) - 1 as index, false cyclic from units left join placed_ using (uid)", "placed_ as (select 'o:'||o_orderkey uid, row_number() over w place, max('o:'||o_orderkey) over w high from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey desc rows unbounded preceding))"))
def store_order(spark, d):
    """The order of the whole store along causes, a path for each customer: what rests on nothing first, always the least unit that is ready."""
    return graph.store_order(T.edges(spark, d, ("causes",)), T.units(spark, d), ("causes",))


@query(sql("select uid, cast(max(level) as int) level from down group by uid", SUPPORT_PAIRS, "down(uid, level) as (select uid, 0 from (select src uid from pairs union select dst from pairs) where uid not in (select src from pairs) union select src, level+1 from down join pairs on dst = uid)", kinds=('grounds', 'deps')))
def topo_levels(spark, d):
    return graph.levels(support(spark, d))


CHAIN = "down(uid, last, depth) as (select b, b, cast(0 as bigint) from by_date where b is not null and b not in (select a from by_date where b is not null) union all select y.a, x.last, x.depth+1 from down x join by_date y on y.b = x.uid)"


@query(sql("select uid, last, depth from down where depth > 0", CHAIN))
def supersession_depth(spark, d):
    return graph.chains(T.edges(spark, d, ("supersedes",)))


NEWEST = "up(uid, last, n) as (select a, a, 0 from by_date where a not in (select b from by_date where b is not null) union all select y.b, x.last, x.n+1 from up x join by_date y on y.a = x.uid where y.b is not null)"


@query(sql("select uid, last successor, cast(n as bigint) depth from up where n > 0", NEWEST))
def relink_successor(spark, d):
    """What each superseded order's grounds should be re-pointed at: its newest successor."""
    up = T.edges(spark, d, ("supersedes",)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.chains(up).select("uid", F.col("last").alias("successor"), "depth")


# Merging


@query(sql("select coalesce(a.uid,b.uid) uid, case when b.uid is null then 'only_a' when a.uid is null then 'only_b' else 'common' end side from (select uid from units where status >= 2) a full join (select uid from units where kind in ('claim','finding')) b on a.uid=b.uid"))
def store_diff(spark, d):
    u = T.units(spark, d)
    return merge.diff(u.where("status >= 2"), u.where("kind in ('claim','finding')"))


@query(sql("select uid, max({'kind': kind, 'gist': gist, 'status': status}).kind kind, max({'kind': kind, 'gist': gist, 'status': status}).gist gist, max({'kind': kind, 'gist': gist, 'status': status}).status status from (select uid, kind, gist, status from units where status >= 2 union all select uid, kind, gist, 5 - status from units where kind = 'evidence') group by uid"))
def merge_union(spark, d):
    u = T.units(spark, d).select("uid", "kind", "gist", "status")
    return merge.merged(u.where("status >= 2"), u.where("kind = 'evidence'").withColumn("status", 5 - F.col("status")), ["uid"])


@query(sql("select thread, cast(max(turn_.pos) as bigint) pos, max_by(role, turn_) role, max_by(unit, turn_) unit from (select thread, role, unit, {'pos': pos, 'role': role, 'unit': unit} turn_ from steps) group by thread"))
def thread_register_lww(spark, d):
    return merge.last_writer(T.steps(spark, d).select("thread", "pos", "role", "unit"), ["thread"], ["pos"])


@query(sql("select kind, src, dst, count(*) copies from (select src, dst, kind from edges union all select src, dst, kind from edges where kind = 'rebuts') group by kind, src, dst"))
def relation_dedup(spark, d):
    return merge.relations(T.edges(spark, d).union(T.edges(spark, d, ("rebuts",))))


@query(sql("select count(*) n, cast(sum(cast(('0x'||substring(sha256(uid||'|'||kind||'|'||coalesce(gist,'')||'|'||status||'|'||coalesce(source,'')),1,14)) as hugeint)) as varchar) digest from units"))
def state_digest(spark, d):
    return merge.digest(T.units(spark, d))


def forked(spark, d):
    """Pending orders also supersede their customer's first order, so some orders have several successors."""
    orders = T.table(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    more = orders.where("o_orderstatus = 'P'").join(first, "o_custkey").select(T.node("o", "o_orderkey").alias("src"), T.node("o", "first").alias("dst"), F.lit("supersedes").alias("kind"))
    return T.edges(spark, d, ("supersedes",)).union(more)


FORK = """up as (select distinct src "by", dst over_ from (select src, dst from edges where kind='supersedes' union all select 'o:'||o_orderkey, (select 'o:'||min(o_orderkey) from orders x where x.o_custkey = o.o_custkey) from orders o where o_orderstatus = 'P') where src <> dst),
many as (select over_, count(*) n from up group by over_ having count(*) > 1),
direct as (select a.over_, count(*) m from up a join up b on a.over_ = b.over_ join up c on c."by" = a."by" and c.over_ = b."by" group by a.over_)"""


@query(sql("""select u.over_ "over", n, string_agg("by", ',' order by "by") positions from up u join (select m.over_, n from many m left join direct d on d.over_ = m.over_ where coalesce(m,0) < n*(n-1)/2) x on x.over_ = u.over_ group by u.over_, n""".replace("coalesce(m,0)", "coalesce(d.m,0)"), FORK, kinds=('supersedes',)))
def contention_fork(spark, d):
    return merge.forks(forked(spark, d))


SCOPED = "members as (select 'c:'||o_custkey scope, 'o:'||o_orderkey uid from orders union all select 'c:'||o_custkey, dst from orders join edges on src = 'o:'||o_orderkey and kind = 'grounds')"


def scoped(spark, d):
    """(scope, uid): every customer's orders and their lines."""
    orders = T.table(spark, d, "orders").select(T.node("c", "o_custkey").alias("scope"), T.node("o", "o_orderkey").alias("uid"))
    lines = orders.join(T.edges(spark, d, ("grounds",)), F.col("uid") == F.col("src")).select("scope", F.col("dst").alias("uid"))
    return orders.union(lines)


@query(sql("select distinct e.src rebutter, e.dst rebutted from edges e join members a on a.uid = e.src join members b on b.uid = e.dst and b.scope = a.scope where kind = 'rebuts'", SCOPED, kinds=('rebuts', 'grounds')))
def contention_rebuttal(spark, d):
    return merge.live_rebuttals(T.edges(spark, d, ("rebuts",)), scoped(spark, d).select(F.col("scope").alias("thread"), F.col("uid").alias("unit")))


@query(sql("select gist label, min(uid) \"over\", count(distinct uid) n from units where kind in ('data','finding') group by gist having count(distinct uid) > 1"))
def contention_label(spark, d):
    return merge.label_collisions(T.units(spark, d).where("kind in ('data','finding')").select(F.col("gist").alias("label"), "uid"))


FALL = """gr as (select distinct src, dst from edges where kind='grounds' and src in (select uid from units) and dst in (select uid from units)),
r0 as (select distinct dst uid from edges where kind='retracts'),
f1 as (select src uid from gr where src not in (select uid from r0) group by src having bool_and(dst in (select uid from r0))),
r1 as (select uid from r0 union select uid from f1),
f2 as (select src uid from gr where src not in (select uid from r1) group by src having bool_and(dst in (select uid from r1))),
fallen as (select uid, 'retracted' reason from r0 union all select uid, 'orphaned' from f1 union all select uid, 'orphaned' from f2)"""


@query(sql("select u.uid, status, case when reason is null then status else 0 end effective, coalesce(reason,'') reason from units u left join fallen f on f.uid = u.uid", FALL, kinds=('grounds', 'retracts')))
def effective_status_strict(spark, d):
    return merge.effective_status(T.units(spark, d), T.edges(spark, d, ("grounds", "retracts")))


@query(sql("select u.uid, status, case when r0.uid is null then status else 0 end effective, case when r0.uid is null then '' else 'retracted' end reason from units u left join r0 on r0.uid = u.uid", FALL, kinds=('grounds', 'retracts')))
def effective_status_advisory(spark, d):
    return merge.effective_status(T.units(spark, d), T.edges(spark, d, ("grounds", "retracts")), "advisory")


@query(sql("select uid, status, status effective, '' reason from units where uid in (select uid from fallen)", FALL, kinds=("grounds", "retracts")))
def effective_status_ignore(spark, d):
    """Of units that other policies would bring down: with this one all stay as they are."""
    units, edges = T.units(spark, d), T.edges(spark, d, ("grounds", "retracts"))
    fallen = merge.effective_status(units, edges).where("reason <> ''").select("uid")
    return merge.effective_status(units, edges, "ignore").join(fallen, "uid", "left_semi")


PLAN = FALL + """,
s0 as (select uid from r0 union select uid from units where uid like 'o:%' and status = 1),
g1 as (select src uid from gr where src not in (select uid from s0) group by src having bool_and(dst in (select uid from s0))),
s1 as (select uid from s0 union select uid from g1),
g2 as (select src uid from gr where src not in (select uid from s1) group by src having bool_and(dst in (select uid from s1)))"""


@query(sql("select uid, reason from (select uid, 'retracted' reason from s0 union all select uid, 'orphaned' from g1 union all select uid, 'orphaned' from g2) where uid not in (select uid from fallen)", PLAN, kinds=('grounds', 'retracts')))
def retraction_plan(spark, d):
    units = T.units(spark, d)
    return merge.retraction_plan(units, T.edges(spark, d, ("grounds", "retracts")), units.where("kind = 'finding' and status = 1"))


@query(sql("select uid, min(hop) first_hop, max(hop) last_hop, count(distinct agent) n_agents, count(*) n from attestations group by uid"))
def episodes(spark, d):
    return merge.hops(T.attestations(spark, d))


HOP_EDGES = """cust_edges as (select 'c:'||c_custkey src, 'c:'||(c_custkey - 7) dst, case when c_custkey % 3 = 0 then 'retracts' else 'supersedes' end kind from customer),
late as (select * from attestations where cast(substring(uid, 3) as bigint) % 4 = 0 or hop > 4),
firsts as (select uid, min(hop) hop from late group by uid),
touched as (select dst uid, bool_or(kind = 'retracts') r, max(src) filter (kind = 'supersedes') s from cust_edges e left join firsts f on f.uid = e.src where f.hop is null or hop between 2 and 10 group by dst),
changes as (select f.uid, case when hop > 1 then 'added' when t.r then 'retracted' when t.s is not null then 'superseded' else 'survived' end change, t.s from firsts f left join touched t on t.uid = f.uid where hop <= 10)"""


def customer_edges(spark, d):
    """Customers retract or supersede the one seven before."""
    c = T.table(spark, d, "customer")
    return c.select(T.node("c", "c_custkey").alias("src"), T.node("c", F.col("c_custkey") - 7).alias("dst"), F.when(F.col("c_custkey") % 3 == 0, "retracts").otherwise("supersedes").alias("kind"))


def late(spark, d):
    """Attestations as if three of four customers were seen late."""
    return T.attestations(spark, d).where((F.substring("uid", 3, 20).cast("long") % 4 == 0) | (F.col("hop") > 4))


def changes(spark, d):
    return merge.hop_diff(late(spark, d), customer_edges(spark, d), 1, 10)


@query(sql("select uid, change, case when change = 'superseded' then s end successor from changes", HOP_EDGES))
def hop_diff(spark, d):
    return changes(spark, d)


@query(sql("select count(*) filter (change <> 'added') \"before\", count(*) filter (change = 'survived') survived, case when count(*) filter (change <> 'added') = 0 then 1.0 else count(*) filter (change = 'survived') / count(*) filter (change <> 'added') end::double rate from changes", HOP_EDGES))
def survival_rate(spark, d):
    return merge.survival_rate(changes(spark, d))


@query(sql("select agent, count(*) filter (change = 'added') added, count(*) filter (change = 'superseded') superseded, count(*) filter (change = 'retracted') retracted from (select case when change = 'superseded' then s else uid end uid, change from changes where change <> 'survived') c join (select distinct uid, agent from late) a on a.uid = c.uid group by agent", HOP_EDGES))
def hop_by_agent(spark, d):
    return merge.by_agent(changes(spark, d), late(spark, d))


@query(sql("""select n.uid, o.uid was, case when n.family <> o.family then 'template-changed' else 'provider-changed' end change
  from cust_edges e join sets n on n.uid = e.src join sets o on o.uid = e.dst where e.kind = 'supersedes' and o.hop <= 1 and n.hop between 2 and 29 and len(n.family) + len(o.family) > 0 and (n.family <> o.family or n.recipe <> o.recipe)""",
  ",\n".join(HOP_EDGES.split(",\n")[:2]), "sets as (select uid, min(hop) hop, coalesce(list(distinct recipe order by recipe), []) recipe, coalesce(list(distinct family order by family), []) family from late group by uid)"))
def recipe_changes(spark, d):
    return merge.recipe_changes(late(spark, d), customer_edges(spark, d), 1, 29)


COMPACT_KINDS = ("deps", "rebuts", "retracts", "warrant", "supersedes")
RARE_CAUSES = "select src, dst, kind from edges union all select a, n, 'causes' from by_price where n is not null and cast(substring(a, 3) as bigint) % 7 = 0"


@query(sql("""select uid, case when uid in (select uid from held) then 'referenced' when uid in (select src from e where kind = 'retracts' union select dst from e where kind = 'retracts') then 'retracted' else 'dropped' end fate from gone""",
  f"e as ({RARE_CAUSES}), gone as (select distinct dst uid from e where kind = 'supersedes' and src in (select uid from units) and dst in (select uid from units))",
  "held as (select dst uid from e where kind in ('grounds', 'deps') and src not in (select uid from gone) union select unnest([src, dst]) from e where kind not in ('grounds', 'deps') and not (kind = 'supersedes' and dst in (select uid from gone)) and (src in (select uid from gone) or dst in (select uid from gone)))", kinds=COMPACT_KINDS))
def compact_fates(spark, d):
    """Superseded orders in a store without the grounds of customers and the date sequence, and with a seventh of the causes."""
    causes = T.edges(spark, d, ("causes",)).where(F.substring("src", 3, 20).cast("long") % 7 == 0)
    return merge.compactable(T.units(spark, d), T.edges(spark, d, COMPACT_KINDS).union(causes))


# Merging in full


@query(sql("select kind, src, dst, (max({'weight': weight, 'note': coalesce(note, '')})).weight weight, nullif((max({'weight': weight, 'note': coalesce(note, '')})).note, '') note, string_agg(distinct agent, ',' order by agent) agents, min(hop) hop from both_ group by kind, src, dst",
  "both_ as (select 'rebuts' kind, 's:'||l_suppkey src, 'p:'||l_partkey dst, (l_linenumber / 8)::double weight, case when l_tax > 0.04 then 'n:'||l_linenumber end note, 'human:'||l_linestatus agent, l_linenumber % 5 hop from lineitem where l_returnflag = 'R')"))
def relation_union(spark, d):
    """Relations between suppliers and parts that many lines state, with weights, notes and agents."""
    line = T.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    stated = line.select(F.lit("rebuts").alias("kind"), T.node("s", "l_suppkey").alias("src"), T.node("p", "l_partkey").alias("dst"), (F.col("l_linenumber") / 8).alias("weight"), F.when(F.col("l_tax") > 0.04, T.node("n", "l_linenumber")).alias("note"), F.concat(F.lit("human:"), "l_linestatus").alias("agent"), (F.col("l_linenumber") % 5).alias("hop"))
    return merge.relations_union(stated)


@query(sql("select count(*) filter (uid not in (select uid from units where status >= 2)) added, count(*) filter (uid in (select uid from units where status >= 2)) duplicate from (select distinct uid from units where kind in ('claim', 'finding'))"))
def added_counts(spark, d):
    u = T.units(spark, d)
    return merge.added(u.where("status >= 2"), u.where("kind in ('claim', 'finding')"), ["uid"])


@query(sql("select uid, count(*) n, max(hop) last_hop from attestations where uid in (select uid from units where kind = 'claim' and status >= 3) group by uid"))
def late_attestations(spark, d):
    return merge.attached(T.units(spark, d).where("kind = 'claim' and status >= 3"), T.attestations(spark, d))


VIEWS = "views as (select o_orderpriority \"view\", ['c:'||o_custkey, 'o:'||o_orderkey] roots, ['t'||(o_custkey % 5)] threads, case when o_orderstatus = 'P' then ['x.a/b'] else [] end requires, case o_orderstatus when 'F' then 'fine' when 'O' then 'default' else 'coarse' end profile from orders where o_orderkey % 5 = 0)"


def views(spark, d):
    o = T.table(spark, d, "orders").where("o_orderkey % 5 = 0")
    profile = F.when(F.col("o_orderstatus") == "F", "fine").when(F.col("o_orderstatus") == "O", "default").otherwise("coarse")
    return o.select(F.col("o_orderpriority").alias("view"), F.array(T.node("c", "o_custkey"), T.node("o", "o_orderkey")).alias("roots"), F.array(F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string"))).alias("threads"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("x.a/b"))).otherwise(F.array().cast("array<string>")).alias("requires"), profile.alias("profile"))


@query(sql("select \"view\", list_sort(list_distinct(flatten(list(roots)))) roots, list_sort(list_distinct(flatten(list(threads)))) threads, list_sort(list_distinct(flatten(list(requires)))) requires from views group by 1", VIEWS).replace("select \"view\", list_sort(list_distinct(flatten(list(roots)))) roots, list_sort(list_distinct(flatten(list(threads)))) threads, list_sort(list_distinct(flatten(list(requires)))) requires", "select \"view\", array_to_string(list_sort(list_distinct(flatten(list(roots)))), ',') roots, array_to_string(list_sort(list_distinct(flatten(list(threads)))), ',') threads, array_to_string(list_sort(list_distinct(flatten(list(requires)))), ',') requires"))
def view_union(spark, d):
    return merge.views_union(views(spark, d)).select("view", *[F.array_join(c, ",").alias(c) for c in ("roots", "threads", "requires")])


LISTED = ", ".join(f"array_to_string(v.{c}, ',') {c}" for c in ("roots", "threads", "requires"))


@query(sql(f"select \"view\", {LISTED}, v.profile profile from (select \"view\", max({{'roots': roots, 'threads': threads, 'requires': requires, 'profile': profile}}) v from views group by 1)", VIEWS))
def view_register(spark, d):
    """Absorbed views: each name holds one view, whichever store's rows come first."""
    v = views(spark, d)
    absorbed = merge.views_register(v.where("profile = 'fine'"), v.where("profile = 'coarse'"), v.where("profile = 'default'"))
    return absorbed.select("view", *[F.array_join(c, ",").alias(c) for c in ("roots", "threads", "requires")], "profile")


@query(sql("select profile, count(*) n from views group by profile", VIEWS))
def granularity_distribution(spark, d):
    return check.granularity_distribution(views(spark, d))


@query(sql("select case when reason = 'orphaned' then 'E050' end code, uid from fallen where reason = 'orphaned'", FALL, kinds=("grounds", "retracts")))
def retraction_report(spark, d):
    return merge.retraction_report(T.units(spark, d), T.edges(spark, d, ("grounds", "retracts")))


@query(sql("select 'W052' code, uid from r0", FALL, kinds=("grounds", "retracts")))
def retraction_report_advisory(spark, d):
    return merge.retraction_report(T.units(spark, d), T.edges(spark, d, ("grounds", "retracts")), "advisory")


ASKED = "asked as (select 'c:'||c_custkey uid, case when c_custkey % 2 = 0 then 'tool:view' else 'human:x' end agent from customer union all select 'c:'||c_custkey, 'tool:click' from customer where c_custkey % 3 = 0)"


def asked(spark, d):
    """Requests to retract customers, by one agent or two."""
    c = T.table(spark, d, "customer")
    one = c.select(T.node("c", "c_custkey").alias("uid"), F.when(F.col("c_custkey") % 2 == 0, "tool:view").otherwise("human:x").alias("agent"))
    return one.union(c.where("c_custkey % 3 = 0").select(T.node("c", "c_custkey"), F.lit("tool:click")))


@query(sql("""select 'origin' \"rule\", uid, n n_agents, own authorised, case when not own then 'no agent attested it' end refusal from judged union all select 'quorum', uid, n, n >= 2, case when n < 2 then 'too few agents' end from judged union all select 'any', uid, n, true, null from judged""",
  ASKED, "judged as (select a.uid, count(distinct a.agent) n, bool_or(t.agent is not null) own from asked a left join (select distinct uid, agent from attestations) t on t.uid = a.uid and t.agent = a.agent group by a.uid)"))
def retraction_authority(spark, d):
    parts = [merge.authority(asked(spark, d), T.attestations(spark, d), r, 2).select(F.lit(r).alias("rule"), "*") for r in ("origin", "quorum", "any")]
    return check.union(*parts)


CONTENDED = f"""{FORK}, labels_ as (select 'p/'||p_brand||p_type label, 'p:'||p_partkey uid from part), pairs_ as (select distinct e.src, e.dst from edges e where kind = 'rebuts'),
found as (select 'rebuttal' kind, dst over_, src positions from pairs_
  union all select 'label', min(uid), string_agg(distinct uid, ',' order by uid) from labels_ group by label having count(distinct uid) > 1
  union all select 'fork', u.over_, string_agg("by", ',' order by "by") from (select distinct * from up) u join (select m.over_, n from many m left join direct d on d.over_ = m.over_ where coalesce(d.m, 0) < n * (n - 1) / 2) x on x.over_ = u.over_ group by u.over_)"""


@query(sql("select distinct 'k/c'||substring(sha256(kind||'|'||over_||'|'||positions), 1, 23) id, kind, over_ \"over\", positions, (select count(distinct (kind, over_, positions)) from found) > 1000 flood from found", CONTENDED, kinds=("supersedes", "rebuts")))
def contention_list(spark, d):
    """All three detectors, with names that don't depend on who detects; a flood beyond a thousand."""
    steps = T.edges(spark, d, ("rebuts",)).select(F.lit("all").alias("thread"), F.explode(F.array("src", "dst")).alias("unit"))
    labels = T.table(spark, d, "part").select(F.concat(F.lit("p/"), "p_brand", "p_type").alias("label"), T.node("p", "p_partkey").alias("uid"))
    return merge.contentions(T.edges(spark, d, ("rebuts",)).unionByName(forked(spark, d)), steps, labels, cap=1000)


@query(sql("select over_ \"over\", arg_max(\"by\", {'t': (select max(o_orderdate) from orders where 'o:'||o_orderkey = \"by\"), 'b': \"by\"}) \"by\" from up group by over_".replace("(select max(o_orderdate) from orders where 'o:'||o_orderkey = \"by\")", "o_orderdate").replace("from up group", "from up join orders on 'o:'||o_orderkey = \"by\" group"), FORK, kinds=("supersedes",)))
def supersession_latest(spark, d):
    """The successor with the latest order date, of orders with one or several."""
    clocks = T.table(spark, d, "orders").select(T.node("o", "o_orderkey").alias("uid"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("wall"), F.lit(0).alias("counter"), F.lit("").alias("agent"))
    return merge.latest(forked(spark, d), clocks)


NEWEST_FORKED = """succ as (select distinct over_ uid, "by" from up), beaten as (select distinct s.uid, s."by" from succ s join succ t on t.uid = s."by" join succ o on o.uid = s.uid and o."by" = t."by"),
heads_ as (select uid, count(*) n, max("by") "by" from (select * from succ except select * from beaten) group by uid), one as (select uid, "by" from heads_ where n = 1),
follow(uid, last, depth) as (select uid, "by", 1 from one union all select f.uid, o."by", depth + 1 from follow f join one o on o.uid = f.last where depth < 100),
ends as (select uid, last, depth from follow where last not in (select uid from one))"""


@query(sql("""select src, dst, kind, e.last now, case when e.last is not null then 'moved' when dst in (select uid from succ) and dst not in (select uid from one) then 'forked' else 'kept' end fate
  from (select distinct src, dst, kind from edges where kind in ('grounds', 'deps')) r left join ends e on e.uid = r.dst where src not in (select uid from succ)""", FORK, NEWEST_FORKED, kinds=("supersedes", "grounds", "deps")))
def relink_references(spark, d):
    return merge.relink(T.units(spark, d), support(spark, d).unionByName(forked(spark, d)))


FELL = """gr as (select distinct src, dst from edges where kind = 'grounds'),
m0 as (select uid, kind, status was, status, source is not null sourced from units)"""


def _fell(n: int) -> str:
    low = "greatest(1, case when least(m.status, w.s) >= 4 and not sourced then 3 else least(m.status, w.s) end)"
    return ", ".join([FELL] + [f"m{i + 1} as (select m.uid, was, case when m.status > w.s and {low} < m.status then {low} else m.status end status, sourced from m{i} m left join (select src, min(status) s from gr join m{i} on uid = dst group by src) w on w.src = m.uid)" for i in range(n)])


@query(sql("select m.uid, was, status::int status, w.g ground from m4 m join (select src, min({'s': status, 'g': uid}).g g from gr join m4 on uid = dst group by src) w on w.src = m.uid where status < was", _fell(4), kinds=("grounds",)))
def monotone_status(spark, d):
    """Statuses lowered to what grounds bear: lines, orders, customers, so three levels and one to see that it ends; the ground is the weakest in the end."""
    return merge.monotone(T.units(spark, d), T.edges(spark, d, ("grounds",)))


# Salience

RANK_PAIRS = "rp as (select distinct src, dst from edges where kind in ('deps','grounds','causes')), dg as (select src, count(*) degree from rp group by src), nd as (select uid, max(seeded) / (select count(*) from units) start, not exists (select 1 from dg where dg.src = n.uid) sink from (select uid, 1.0 seeded from units union all select src, 0 from rp union all select dst, 0 from rp) n group by uid)"


def _rank_sql() -> str:
    steps = ["k0 as materialized (select uid, start, sink, start::double rank from nd)"]
    for i in range(salience.ITERATIONS):
        steps.append(f"k{i + 1} as materialized (select n.uid, n.start, n.sink, 0.15 * n.start::double + 0.85 * (coalesce(f.flow, 0) + (select coalesce(sum(rank), 0) from k{i} where sink) * n.start::double) rank from nd n left join (select dst uid, sum(rank / degree) flow from k{i} join rp on rp.src = uid join dg on dg.src = uid group by dst) f on f.uid = n.uid)")
    return ", ".join([RANK_PAIRS.replace("nd as (", "nd as materialized ("), *steps])


RANK = _rank_sql()
RANK_END = f"ranked as (select uid, {quantise(f'rank / (select max(rank) from k{salience.ITERATIONS})')} rank from k{salience.ITERATIONS})"


def small_graph(spark, d):
    """Customers, their nations and regions, and causes between customers' orders: the rank's graph without lines."""
    return T.units(spark, d), T.edges(spark, d, ("deps", "grounds", "causes"))


@query(sql("select uid, rank from ranked", RANK, RANK_END, kinds=('deps', 'grounds', 'causes')))
def pagerank(spark, d):
    return salience.pagerank(*small_graph(spark, d)).select("uid", S.quantise(F.col("rank")).alias("rank"))


CORR = """grp as (select uid, agent||'#'||recipe key, list(distinct parent) parents from attestations group by uid, agent, recipe),
ord as (select *, row_number() over (partition by uid order by key) rn from grp),
fold(uid, rn, n, claimed) as (select uid, 1, 1, parents from ord where rn = 1
  union all select f.uid, f.rn + 1, case when list_has_any(f.claimed, o.parents) then n else n + 1 end, case when list_has_any(f.claimed, o.parents) then claimed else list_distinct(list_concat(claimed, o.parents)) end from fold f join ord o on o.uid = f.uid and o.rn = f.rn + 1),
corr as (select uid, cast(max(rn) as bigint) groups, cast(max_by(n, rn) as bigint) counted, least(max_by(n, rn), 4) / 4.0 corroboration from fold group by uid)"""


@query(sql("select uid, groups, counted, corroboration::double corroboration from corr", CORR))
def corroboration(spark, d):
    return salience.corroboration(T.attestations(spark, d))


@query(sql("select uid, case when 29 - max(hop) >= 24 then 0.0 else pow(2.0, -(29 - max(hop))) end::double recency from attestations group by uid"))
def recency(spark, d):
    return T.attestations(spark, d).groupBy("uid").agg(S.recency(F.lit(29) - F.max("hop")).alias("recency"))


SAL = f"""lastest as (select uid, max(hop) last from attestations group by uid),
terms as (select u.uid, coalesce(r.rank, 0) centrality, coalesce(c.corroboration, 0)::double corroboration, {quantise('u.status / 5.0')}::double as role,
  coalesce(case when 29 - last >= 24 then 0.0 else pow(2.0, -(29 - last)) end, 0)::double recency from units u left join ranked r on r.uid=u.uid left join corr c on c.uid=u.uid left join lastest l on l.uid=u.uid),
scored as (select *, {quantise('greatest(0.0, least(1.0, 0.4::double*centrality + 0.15::double*corroboration + 0.25::double*"role" + 0.2::double*recency))')} salience from terms)"""


def scored(spark, d):
    units, edges = small_graph(spark, d)
    roles = units.select("uid", S.quantise(F.col("status") / 5.0).alias("role"))
    return salience.salience(units, edges, T.attestations(spark, d), roles, 29, "recent")


@query(sql("select uid, centrality, corroboration, \"role\", recency, salience from scored", RANK, RANK_END, CORR, SAL, kinds=('deps', 'grounds', 'causes')))
def salience_full(spark, d):
    return scored(spark, d)


@query(sql("select uid, centrality, corroboration, \"role\", recency, coalesce(groups, 0) groups, coalesce(groups - counted, 0) dependent, salience raw, starts_with(uid, 'c:') and try_cast(substring(uid, 3) as bigint) % 10 = 0 authored, case when starts_with(uid, 'c:') and try_cast(substring(uid, 3) as bigint) % 10 = 0 then 0.5::double else salience end salience from scored left join (select uid, groups, counted from corr) using (uid)", RANK, RANK_END, CORR, SAL, kinds=('deps', 'grounds', 'causes')))
def salience_explained(spark, d):
    """What each score is made of; every tenth customer's is authored."""
    units, edges = small_graph(spark, d)
    roles = units.select("uid", S.quantise(F.col("status") / 5.0).alias("role"))
    tenth = F.col("uid").startswith("c:") & (F.substring("uid", 3, 20).try_cast("long") % 10 == 0)
    return salience.explained(units.withColumn("authored", F.when(tenth, 0.5)), edges, T.attestations(spark, d), roles, 29, "recent")


@query(sql("select uid, salience from scored order by salience desc, uid limit 100", RANK, RANK_END, CORR, SAL, kinds=('deps', 'grounds', 'causes')))
def salience_top(spark, d):
    return scored(spark, d).select("uid", "salience").orderBy(F.desc("salience"), "uid").limit(100)


@query(sql(f"select uid, {quantise('salience / (select max(salience) from s)')}::double salience from s", f"s as (select uid, ({quantise('status / 7.0')})::double salience from units)"))
def renormalise(spark, d):
    return salience.renormalise(T.units(spark, d).select("uid", S.quantise(F.col("status") / 7.0).alias("salience")))
