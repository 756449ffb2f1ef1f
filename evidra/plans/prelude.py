"""The store's tables over the given ones, as common table expressions for the SQL checks."""

import re

LINE = "'l:'||l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||cast(round(l_extendedprice*100) as bigint)||'-'||strftime(l_shipdate,'%Y%m%d')"

EDGES = {
    "grounds": [f"'o:'||l_orderkey, {LINE}, 'grounds' from lineitem", "'c:'||o_custkey, 'o:'||o_orderkey, 'grounds' from orders"],
    "deps": [f"{LINE}, 'p:'||l_partkey, 'deps' from lineitem", f"{LINE}, 's:'||l_suppkey, 'deps' from lineitem", "'c:'||c_custkey, 'n:'||c_nationkey, 'deps' from customer", "'s:'||s_suppkey, 'n:'||s_nationkey, 'deps' from supplier", "'n:'||n_nationkey, 'r:'||n_regionkey, 'deps' from nation"],
    "rebuts": [f"{LINE}, 'o:'||l_orderkey, 'rebuts' from lineitem where l_returnflag = 'R'"],
    "retracts": [f"{LINE}, {LINE}, 'retracts' from lineitem where l_returnflag = 'A'"],
    "warrant": [f"'p:'||l_partkey, {LINE}, 'warrant' from lineitem"],
    "supersedes": ["a, b, 'supersedes' from by_date where b is not null"],
    "sequences": ["a, n, 'sequences' from by_date where n is not null"],
    "causes": ["a, n, 'causes' from by_price where n is not null"],
}

#: The store's tables in the order they build on each other; a query gets those it names.
TABLES = {
    "units": f"""(
  select 'r:'||r_regionkey uid, 'definition' kind, r_name gist, 5 status, 'doc:region' source from region
  union all select 'n:'||n_nationkey, 'definition', n_name, 5, 'doc:nation' from nation
  union all select 's:'||s_suppkey, 'observation', s_name, 5, 'doc:supplier' from supplier
  union all select 'p:'||p_partkey, 'data', p_name||' '||p_brand||' '||p_type, 5, case when p_size > 5 then 'doc:part' end from part
  union all select 'c:'||c_custkey, 'claim', c_name, case c_mktsegment when 'AUTOMOBILE' then 5 when 'BUILDING' then 4 when 'FURNITURE' then 3 when 'HOUSEHOLD' then 2 else 1 end, case when c_acctbal > 0 then 'doc:customer' end from customer
  union all select 'o:'||o_orderkey, 'finding', o_orderpriority||' '||o_orderstatus, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end, null from orders
  union all select {LINE}, 'evidence', l_returnflag||' '||l_linestatus, case l_returnflag when 'A' then 2 when 'N' then 4 else 1 end, case when l_tax > 0 then 'doc:lineitem' end from lineitem)""",
    "by_date": "(select 'o:'||o_orderkey a, 'o:'||lag(o_orderkey) over w b, 'o:'||lead(o_orderkey) over w n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))",
    "by_price": "(select 'o:'||o_orderkey a, 'o:'||lead(o_orderkey) over w n from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey))",
    "edges": "",
    "attestations": """(
  select 'c:'||user_id uid, 'tool:'||event_type agent, cast(datediff('day', date '2024-01-01', cast(ts as date)) as int) hop,
    case event_type when 'purchase' then 'computed' when 'view' then 'document' when 'click' then 'web' else 'model' end rung,
    case event_type when 'purchase' then 'imported' when 'view' then 'transformed' when 'click' then 'attested' else 'authored' end op,
    cast(json_extract(props, '$.k') as int) recipe, cast(json_extract(props, '$.k') as int) % 7 family, 'e:'||(event_id % 50) parent, event_id from events)""",
    "steps": "(select conv_id thread, turn pos, role, 't:'||conv_id||'-'||turn unit, text from conversations)",
    "docs": """(
  select 'd:'||doc_id uid, substring(text, 1, 120) gist, text body, case when quality = 1 then 4 when quality = 0 then 1 else 2 end status, coalesce(toxic = 1, false) retracted, lang, source
  from documents left join labels using (doc_id))""",
}


def _recursive(text: str) -> bool:
    """Whether a common table expression names itself."""
    for m in re.finditer(r"(\w+)(?:\s*\([^()]*\))? as (?:materialized )?\(", text):
        depth, at = 1, m.end()
        while depth and at < len(text):
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        if re.search(rf"\b{m[1]}\b", text[m.end() : at]):
            return True
    return False


def sql(body: str, *more: str, kinds: tuple[str, ...] | None = None) -> str:
    """A query over those of the store's tables that it names, edges of these kinds alone; more: further common table expressions."""
    text, wanted = " ".join([body, *more]), []
    for name in reversed(TABLES):
        own = TABLES[name] or _edges(kinds)
        if re.search(rf"\b{name}\b", text):
            wanted.append(f"{name} as {own}")
            text += own
    tables = [*reversed(wanted), *(m.strip() for m in more)]
    return f"with {'recursive ' * _recursive(','.join(tables))}{','.join(tables)}\n{body.strip()}" if tables else body.strip()


def _edges(kinds: tuple[str, ...] | None) -> str:
    rows = [r for k in kinds or EDGES for r in EDGES[k]]
    return f"(select * from (select null::varchar src, null::varchar dst, null::varchar kind where false union all {' union all '.join(f'select {r}' for r in rows)}))"


def tokens(c: str) -> str:
    return f"cast(coalesce(ceil(strlen({c}) / 4.0), 0) as bigint)"


def quantise(x: str) -> str:
    return f"round(({x}) * 1024) / 1024"
