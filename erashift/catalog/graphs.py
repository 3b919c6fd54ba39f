"""Graph features, diagnostics, walks and embeddings."""

from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.catalog.fixtures import SQL_VIEWS
from erashift.catalog.registry import query, rounded
from erashift.operators import embeddings, graph, graph_iterative, profile
from erashift.plans.features import graph_features as build_graph_features

SQL_VIEWS["ox_degrees"] = """
select dataset, user_id, cast(sum(i) as bigint) as graph_in_degree, cast(sum(o) as bigint) as graph_out_degree,
  count(*) as graph_degree_total, sum(i) / (sum(o) + 1)::double as graph_ff_ratio
from (select dataset, source_id as user_id, 0 as i, 1 as o from fx_edges
      union all select dataset, target_id, 1, 0 from fx_edges) group by dataset, user_id
"""

SQL_VIEWS["ox_reciprocity"] = """
select e.dataset, e.source_id as user_id, count(r.source_id) as graph_reciprocity_count,
  count(r.source_id) / (count(*) + 1)::double as graph_reciprocity_ratio
from fx_edges e left join fx_edges r on r.dataset = e.dataset and r.source_id = e.target_id and r.target_id = e.source_id
group by e.dataset, e.source_id
"""

SQL_VIEWS["ox_neighbors"] = """
select v.dataset, v.me as user_id, avg(d.graph_in_degree) as graph_neighbor_avg_in_degree,
  avg(d.graph_out_degree) as graph_neighbor_avg_out_degree, avg(d.graph_degree_total) as graph_neighbor_avg_degree_total,
  avg(d.graph_ff_ratio) as graph_neighbor_avg_ff_ratio,
  case when count(*) > 1 then sqrt((count(*) * sum(d.graph_degree_total * d.graph_degree_total)
      - sum(d.graph_degree_total) * sum(d.graph_degree_total))::double / (count(*) * (count(*) - 1))::double)
    else 0.0::double end as graph_neighbor_std_degree_total
from (select dataset, source_id as me, target_id as other from fx_edges
      union all select dataset, target_id, source_id from fx_edges) v
join ox_degrees d on d.dataset = v.dataset and d.user_id = v.other group by v.dataset, v.me
"""

SQL_VIEWS["ox_pairs"] = """
select distinct dataset, least(source_id, target_id) as lo, greatest(source_id, target_id) as hi from fx_edges
"""

SQL_VIEWS["ox_ego"] = """
select d.dataset, d.user_id, d.deg + 1 as graph_ego_node_count, d.deg + coalesce(t.tri, 0) as graph_ego_edge_count,
  (d.deg + coalesce(t.tri, 0)) / ((d.deg + 1) * d.deg / 2.0::double) as graph_ego_density
from (select dataset, user_id, count(*) as deg from
        (select dataset, lo as user_id from ox_pairs union all select dataset, hi from ox_pairs) group by all) d
left join (select dataset, user_id, count(*) as tri from (
    select a.dataset, unnest([a.lo, a.hi, b.hi]) as user_id from ox_pairs a
    join ox_pairs b on b.dataset = a.dataset and b.lo = a.hi
    join ox_pairs c on c.dataset = a.dataset and c.lo = a.lo and c.hi = b.hi) group by all) t
  on t.dataset = d.dataset and t.user_id = d.user_id
"""


def components_sql(edges: str) -> str:
    """Smallest reachable node by a recursive CTE, then the size of its group."""
    return f"""
with recursive und as (
  select dataset, source_id as a, target_id as b from {edges} union select dataset, target_id, source_id from {edges}
), reach as (
  select dataset, a as node, a as seen from und union
  select r.dataset, r.node, u.b from reach r join und u on u.dataset = r.dataset and u.a = r.seen
)
select dataset, node as user_id, count(distinct seen) as graph_component_size from reach group by dataset, node
"""


def least_label_sql(edges: str, rounds: int) -> str:
    """Unrolled rounds of taking the smallest label around; the graph's diameter must not exceed them."""
    parts = [f"und as materialized (select dataset, source_id as a, target_id as b from {edges} union select dataset, target_id, source_id from {edges})",
             "l0 as materialized (select distinct dataset, a, a as label from und)"]
    for k in range(1, rounds + 1):
        parts.append(f"""l{k} as materialized (
  select l.dataset, l.a, least(l.label, min(n.label)) as label from l{k - 1} l join und u on u.dataset = l.dataset and u.a = l.a
  join l{k - 1} n on n.dataset = l.dataset and n.a = u.b group by l.dataset, l.a, l.label)""")
    return (f"with {', '.join(parts)}\nselect dataset, a as user_id, count(*) over (partition by dataset, label) as graph_component_size "
            f"from l{rounds}")


def pagerank_sql(edges: str, rounds: int) -> str:
    """Unrolled power iteration; per era the first round with a change below N * 1e-6."""
    damping, tolerance = fv.PAGERANK_DAMPING, fv.PAGERANK_TOLERANCE
    parts = [f"""nodes as materialized (
  select *, count(*) over (partition by dataset) as n from (
    select dataset, user_id, cast(sum(o) as double) as o from (
      select dataset, source_id as user_id, 1 as o from {edges} union all select dataset, target_id, 0 from {edges}
    ) group by all))""",
             "r0 as materialized (select dataset, user_id, o, n, 1.0::double / n as rank, 0.0::double as change from nodes)"]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as materialized (
  select p.dataset, p.user_id, p.o, p.n,
    {damping}::double * (coalesce(g.got, 0) + coalesce(d.lost, 0) / p.n) + {1 - damping}::double / p.n as rank,
    sum(abs({damping}::double * (coalesce(g.got, 0) + coalesce(d.lost, 0) / p.n) + {1 - damping}::double / p.n - p.rank))
      over (partition by p.dataset) as change
  from r{k - 1} p
  left join (select e.dataset, e.target_id, sum(s.rank / s.o) as got from {edges} e
             join r{k - 1} s on s.dataset = e.dataset and s.user_id = e.source_id group by all) g
    on g.dataset = p.dataset and g.target_id = p.user_id
  left join (select dataset, sum(rank) as lost from r{k - 1} where o = 0 group by dataset) d on d.dataset = p.dataset)""")
    every = " union all ".join(f"select {k} as k, * from r{k}" for k in range(1, rounds + 1))
    return f"""with {', '.join(parts)},
every as ({every}),
stop as (select dataset, min(k) as k from every where change < n * {tolerance}::double group by dataset)
select e.dataset, e.user_id, e.rank as graph_pagerank, 0 as graph_pagerank_sampled
from every e join stop s on s.dataset = e.dataset and s.k = e.k"""


SQL_VIEWS["ox_components"] = components_sql("fx_edges")
SQL_VIEWS["ox_pagerank"] = pagerank_sql("fx_edges", 25)

SQL_VIEWS["ox_graph"] = """
select d.*, coalesce(r.graph_reciprocity_count, 0) as graph_reciprocity_count,
  coalesce(r.graph_reciprocity_ratio, 0) as graph_reciprocity_ratio, p.graph_pagerank, p.graph_pagerank_sampled,
  c.graph_component_size, n.* exclude (dataset, user_id), e.* exclude (dataset, user_id)
from ox_degrees d left join ox_reciprocity r using (dataset, user_id) left join ox_components c using (dataset, user_id)
left join ox_neighbors n using (dataset, user_id) left join ox_pagerank p using (dataset, user_id)
left join ox_ego e using (dataset, user_id)
"""

GRAPH_INTS = ["graph_in_degree", "graph_out_degree", "graph_degree_total", "graph_reciprocity_count",
              "graph_component_size", "graph_pagerank_sampled", "graph_ego_node_count", "graph_ego_edge_count"]


def graph_list(cols, prefix=""):
    return ", ".join(f"{prefix}{c}" if c in GRAPH_INTS else f"round({prefix}{c}, 6) as {c}" for c in cols)


@query("graph_degrees", f"""
select dataset, user_id, {graph_list(fv.GRAPH_COLS[:4])} from ox_degrees
""")
def graph_degrees(t):
    return rounded(graph.graph_degrees(t.fx_edges))


@query("graph_reciprocity", f"select dataset, user_id, {graph_list(fv.GRAPH_COLS[4:6])} from ox_reciprocity")
def graph_reciprocity(t):
    return rounded(graph.graph_reciprocity(t.fx_edges))


@query("graph_neighbor_agg", f"select dataset, user_id, {graph_list(fv.GRAPH_COLS[9:14])} from ox_neighbors")
def graph_neighbor_agg(t):
    return rounded(graph.graph_neighbor_agg(t.fx_edges))


@query("graph_ego_density", f"select dataset, user_id, {graph_list(fv.GRAPH_COLS[14:])} from ox_ego")
def graph_ego_density(t):
    return rounded(graph.graph_ego_density(t.fx_edges))


@query("graph_components", least_label_sql("fx_edges_sparse", 12))
def graph_components(t):
    return graph_iterative.graph_components(t.fx_edges_sparse)


@query("graph_pagerank", f"""
select dataset, user_id, round(graph_pagerank, 9) as graph_pagerank, graph_pagerank_sampled from ({pagerank_sql('all_edges', 70)})
""".replace("all_edges", "(select 'dense ' || dataset as dataset, source_id, target_id from fx_edges union all "
                         "select * from fx_edges_sparse)"))
def graph_pagerank(t):
    """Dense eras and sparse ones with dangling mass, each with its own stopping round."""
    dense = t.fx_edges.withColumn("dataset", F.concat(F.lit("dense "), "dataset"))
    return rounded(graph_iterative.graph_pagerank(dense.unionByName(t.fx_edges_sparse)), digits=9)


@query("degree_distribution", """
select dataset, graph_degree_total, count(*) as n_users from ox_degrees group by all
""")
def degree_distribution(t):
    return graph.degree_distribution(graph.graph_degrees(t.fx_edges))


@query("label_diagnostics", """
select *, round(case when following is null then follower when follower is null then following
    else (following + follower) / 2 end, 6) as neighbor_bot_ratio,
  round(following, 6) as following_bot_ratio, round(follower, 6) as follower_bot_ratio
from (select v.dataset, v.me as user_id, avg(case when outward = 1 then is_bot end) as following,
        avg(case when outward = 0 then is_bot end) as follower
  from (select dataset, source_id as me, target_id as other, 1 as outward from fx_edges
        union all select dataset, target_id, source_id, 0 from fx_edges) v
  left join (select dataset, user_id, case when lower(label) = 'bot' then 1 else 0 end as is_bot
             from (select dataset, user_id, case when label = 'Bot ' and cast(user_id as bigint) % 2 = 0 then 'Bot' else label end as label from fx_users)) l
    on l.dataset = v.dataset and l.user_id = v.other group by v.dataset, v.me)
""".replace("select *, round(case", "select dataset, user_id, round(case"))
def label_diagnostics(t):
    """Half the bots have a padded label, which this reading does not call a bot."""
    trimmed = F.when((F.col("label") == "Bot ") & (F.col("user_id").cast("bigint") % 2 == 0), "Bot")
    users = t.fx_users.withColumn("label", F.coalesce(trimmed, "label"))
    return rounded(graph.label_diagnostics(t.fx_edges, users))


@query("graph_features", f"select dataset, user_id, {graph_list(fv.GRAPH_COLS)} from ox_graph")
def graph_features(t):
    return rounded(build_graph_features(t.fx_edges))


_MERGED = f"""
select u.dataset, u.user_id, u.label, {', '.join(
    f'coalesce(g.{c}, 0) as {c}' if c in fv.GRAPH_ZERO_COLS else f'g.{c}' for c in fv.GRAPH_COLS)}
from fx_users u left join ox_graph g on g.dataset = u.dataset and g.user_id = u.user_id
"""


def merged_of(t):
    base = t.fx_users.select("dataset", "user_id", "label")
    return graph.graph_merge(base, build_graph_features(t.fx_edges))


@query("graph_merge", f"select dataset, user_id, label, {graph_list(fv.GRAPH_COLS)} from ({_MERGED})")
def graph_merge(t):
    return rounded(merged_of(t))


@query("missing_graph_counts", " union all ".join(
    f"select '{c}' as \"column\", cast(count(*) filter ({c} is null) as bigint) as nulls from ({_MERGED})"
    for c in fv.GRAPH_COLS))
def missing_graph_counts(t):
    return graph.missing_graph_counts(merged_of(t))


@query("graph_summary", " union all ".join(
    f"select dataset, '{c}' as col, round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(max({c}), 4)::double as max "
    f"from ({_MERGED}) group by dataset" for c in ["graph_in_degree", "graph_pagerank"]))
def graph_summary(t):
    return profile.graph_summary(merged_of(t))


@query("isolated_users", f"""
select dataset, label, count(*) as n_users from ({_MERGED})
where graph_degree_total = 0 and graph_reciprocity_count = 0 and label is not null group by dataset, label
""")
def isolated_users(t):
    return graph.isolated_users(merged_of(t))


_STEPS = fv.WALK_LENGTH - 1


def walks_sql(edges: str, num_walks: int, seed: int) -> str:
    parts = [f"""arcs as materialized (
  select *, row_number() over (partition by dataset, source_id order by target_id) - 1 as idx,
    count(*) over (partition by dataset, source_id) as fan_out from {edges})""",
             f"""w0 as (select dataset, user_id, walk, [user_id] as path, user_id as at
  from (select dataset, source_id as user_id from {edges} union select dataset, target_id from {edges})
  cross join range({num_walks}) r(walk))"""]
    for k in range(1, _STEPS + 1):
        parts.append(f"""w{k} as materialized (
  select w.dataset, w.user_id, w.walk, case when a.target_id is null then w.path else list_append(w.path, a.target_id) end as path,
    a.target_id as at
  from w{k - 1} w left join (select distinct dataset, source_id, fan_out from arcs) f on f.dataset = w.dataset and f.source_id = w.at
  left join arcs a on a.dataset = w.dataset and a.source_id = w.at
    and a.idx = cast('0x' || substr(md5(concat('{seed}|', w.user_id, '|', w.walk, '|', {k})), 1, 12) as bigint) % f.fan_out)""")
    return (f"with {', '.join(parts)}\nselect dataset, user_id, cast(walk as integer) as walk, "
            f"array_to_string(path, ' ') as path from w{_STEPS}")


@query("random_walks", walks_sql("fx_edges", fv.WALKS_PER_NODE, fv.SEED))
def random_walks(t):
    walks = graph_iterative.random_walks(t.fx_edges)
    return walks.withColumn("path", F.concat_ws(" ", "path"))


@query("node_embeddings")
def node_embeddings(t):
    """Skip-gram vectors of the sparse eras (rows only: the fit is stochastic)."""
    return embeddings.node_embeddings(t.fx_edges)


@query("embedding_merge", """
select u.dataset, u.user_id, u.label, case when e.vec_id is null then rtrim(repeat('0,', 64), ',') else
  array_to_string(list_transform(e.embedding, lambda x: floor(x::double * 100000)::bigint), ',') end as emb
from fx_users u left join embeddings e on cast(e.vec_id as varchar) = u.user_id
""")
def embedding_merge(t):
    """Stored vectors joined by user id, all dimensions; each given twice to exercise de-duplication."""
    eras = t.fx_users.select("dataset", "user_id")
    stored = t.embeddings.select(F.col("vec_id").cast("string").alias("user_id"), F.col("embedding").alias("emb"))
    keyed = eras.join(stored, "user_id")
    merged = embeddings.embedding_merge(t.fx_users.select("dataset", "user_id", "label"), keyed.unionByName(keyed))
    digits = F.transform("emb", lambda x: F.floor(x.cast("double") * 100000).cast("string"))
    return merged.select("dataset", "user_id", "label", F.array_join(digits, ",").alias("emb"))
