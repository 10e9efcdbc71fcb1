"""Policy evaluation: requests against statements, explicit deny first.

statements: ``sid``, ``effect``, ``principal`` and ``not_principal`` (map<kind, array<name>>, kind ``*`` for anyone),
``action``, ``not_action``, ``resource``, ``not_resource`` (arrays of globs, null or empty if absent), ``condition``
(see functions.conditions), and where policies are attached ``policy_id``. requests: ``req_id``, ``principal_arn``,
``action``, ``resource_arn``, ``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.conditions import block_holds
from gatelens.functions.globs import action_matches, any_action, any_resource, normal_action
from gatelens.plans.steps import step

STATEMENT = (
    "sid string, effect string, principal map<string, array<string>>, not_principal map<string, array<string>>, action array<string>, not_action array<string>, "
    "resource array<string>, not_resource array<string>, condition map<string, map<string, array<string>>>"
)
#: Statements up to this many rows are broadcast, which is checked. Of more, those whose actions all name a service are
#: joined by it, and the others are broadcast in blocks of about half this size, one after another.
BROADCAST_STATEMENTS = 10_000


def _some(x: Column) -> Column:
    return F.coalesce(F.size(x) > 0, F.lit(False))


def principal_matches(principal: Column, arn: Column) -> Column:
    """Any kind names the principal or anyone; names are not globs."""
    return F.coalesce(F.exists(F.flatten(F.map_values(principal)), lambda p: (p == "*") | (p == arn)), F.lit(False))


def statement_applies(s: str | Column, r: str) -> Column:
    """Boolean column over a row that holds statement struct ``s``, by name or as an expression, and request struct ``r``."""
    c = lambda name: F.col(f"{s}.{name}") if isinstance(s, str) else s[name]
    arn, action, resource = F.col(f"{r}.principal_arn"), F.col(f"{r}.action"), F.col(f"{r}.resource_arn")
    context = F.map_concat(F.map_filter(F.coalesce(F.col(f"{r}.context"), F.expr("cast(map() as map<string, array<string>>)")), lambda k, _: k != "aws:PrincipalArn"),
                           F.map_from_arrays(F.array(F.lit("aws:PrincipalArn")), F.array(F.coalesce(F.try_element_at(F.col(f"{r}.context"), F.lit("aws:PrincipalArn")), F.array(arn)))))
    return (
        (c("principal").isNull() | principal_matches(c("principal"), arn))
        & (c("not_principal").isNull() | ~principal_matches(c("not_principal"), arn))
        & F.when(_some(c("action")), any_action(action, c("action"))).when(_some(c("not_action")), ~any_action(action, c("not_action"))).otherwise(True)
        & F.when(_some(c("resource")), any_resource(resource, c("resource"))).when(_some(c("not_resource")), ~any_resource(resource, c("not_resource"))).otherwise(True)
        & block_holds(c("condition"), context)
    )


def _service(action: Column) -> Column:
    return F.split_part(normal_action(action), F.lit(":"), F.lit(1))


def matches(requests: DataFrame, statements: DataFrame, on: Column | None = None) -> DataFrame:
    """(r, s): every request struct with every statement struct that applies to it."""
    r = requests.select(F.struct("*").alias("r"))
    s = statements.select(F.struct("*").alias("s"))
    fits = statement_applies("s", "r") if on is None else on & statement_applies("s", "r")
    if statements.limit(BROADCAST_STATEMENTS + 1).count() <= BROADCAST_STATEMENTS:
        return r.join(F.broadcast(s), fits)
    named = F.transform("s.action", _service)
    literal = F.coalesce((F.size("s.action") > 0) & ~F.exists(named, lambda x: F.rlike(x, F.lit(r"[*?\[]"))), F.lit(False))
    by_service = s.where(literal).select("s", F.explode(F.array_distinct(named)).alias("service"))
    out = r.withColumn("service", _service(F.col("r.action"))).join(by_service, "service").where(fits).select("r", "s")
    loose = s.where(~literal)
    blocks = -(-2 * loose.count() // BROADCAST_STATEMENTS)
    for b in range(blocks):
        out = out.unionByName(r.join(F.broadcast(loose.where(F.pmod(F.xxhash64("s.sid", "s.effect", "s.action", "s.resource"), F.lit(blocks)) == b)), fits))
    return out


def decide(requests: DataFrame, statements: DataFrame, on: Column | None = None) -> DataFrame:
    """(req_id, decision, allows, denies): a matching deny wins, else an allow, else implicit deny; sorted statement ids.

    ``on`` may bind statements to requests, e.g. by the policies that govern a principal. Requests that repeat a req_id
    are one request: whatever any of them matches counts.
    """
    return _decided(matches(requests, statements, on).select("r.req_id", "s.effect", "s.sid"), requests)


def _decided(hits: DataFrame, requests: DataFrame) -> DataFrame:
    # a row of its own for each request, so that one that matches nothing is there too
    every = hits.unionByName(requests.select("req_id", F.lit(None).cast("string").alias("effect"), F.lit(None).cast("string").alias("sid")))
    sids = lambda effect: F.array_sort(F.collect_list(F.when(F.col("effect") == effect, F.col("sid"))))
    some = lambda effect: F.coalesce(F.bool_or(F.col("effect") == effect), F.lit(False))
    found = every.groupBy("req_id").agg(some("Deny").alias("denied"), some("Allow").alias("allowed"), sids("Allow").alias("allows"), sids("Deny").alias("denies"))
    return found.select("req_id", F.when(F.col("denied"), "ExplicitDeny").when(F.col("allowed"), "Allow").otherwise("ImplicitDeny").alias("decision"), "allows", "denies")


def governed_matches(requests: DataFrame, statements: DataFrame) -> DataFrame:
    """(r, s) where requests name the policy that governs them, ``policy_id``, one row for each: joined by it, so that no
    request meets statements of other policies."""
    r = requests.select("policy_id", F.struct(*[c for c in requests.columns if c != "policy_id"]).alias("r"))
    return r.join(statements.select("policy_id", F.struct("*").alias("s")), "policy_id").where(statement_applies("s", "r")).select("r", "s")


def authorized_actions(principal: str, resource: str, actions: DataFrame, statements: DataFrame) -> DataFrame:
    """The distinct actions of ``actions(action)`` that a principal may take on a resource."""
    asked = actions.select("action").distinct().select(F.col("action").alias("req_id"), F.lit(principal).alias("principal_arn"), "action", F.lit(resource).alias("resource_arn"), F.expr("cast(map() as map<string, array<string>>)").alias("context"))
    return decide(asked, statements).where("decision = 'Allow'").select(F.col("req_id").alias("action"))


def owners(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, owner): each of ids(id), and the groups that it is a member of; policies are attached to owners."""
    who = ids.select("id").distinct()
    member = edges.where("relation = 'MemberOf'").select(F.col("src").alias("id"), F.col("dst").alias("owner")).join(who, "id", "left_semi")
    return who.select("id", F.col("id").alias("owner")).unionByName(member).distinct()


def _literal(pattern: Column) -> Column:
    return F.coalesce(~F.rlike(pattern, F.lit(r"[*?\[]")), F.lit(False))


def _keys(patterns: Column, normal) -> Column:
    """What a value that one of the patterns fits must equal: the pattern, or ``*`` where that doesn't say."""
    each = F.array_distinct(F.transform(patterns, lambda p: F.when(_literal(p), normal(p)).otherwise("*")))
    return F.when(_some(patterns), each).otherwise(F.array(F.lit("*")))


def owned_statements(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """(owner, act, place, s): statements of the policies attached to each owner; equal ones, whatever their policy and sid,
    are one, so that an owner of many policies has no more rows than there are different statements. One row for each
    literal action and resource, which requests must equal, or ``*``."""
    fields = [F.col(c) for c in ("effect", "principal", "not_principal", "action", "not_action", "resource", "not_resource", "condition")]
    attached = edges.where("relation = 'AttachedWith'").select(F.col("src").alias("owner"), F.col("dst").alias("policy_id")).distinct()
    s = F.struct(*fields)
    held = attached.join(statements, "policy_id").select("owner", s.alias("s"), F.to_json(s, {"ignoreNullFields": "false"}).alias("text"))
    once = held.groupBy("owner", "text").agg(F.first("s").alias("s"))
    acts = once.select("owner", "s", F.explode(_keys(F.col("s.action"), normal_action)).alias("act"))
    return acts.select("owner", "act", F.explode(_keys(F.col("s.resource"), F.trim)).alias("place"), "s")


def owned_effects(requests: DataFrame, edges: DataFrame, statements: DataFrame) -> DataFrame:
    """(req_id, effect): of the statements that govern the requests' principals, ``id``, directly or over a group, and apply.

    Pairs of a principal and a policy of its group are never made: requests meet the group's different statements, of
    these those that name their action and resource, or neither."""
    fields = F.struct("req_id", "principal_arn", "action", "resource_arn", "context")
    keyed = requests.join(owners(edges, requests), "id").select("owner", fields.alias("r"))
    keyed = keyed.select("owner", "r", F.explode(F.array_distinct(F.array(normal_action(F.col("r.action")), F.lit("*")))).alias("act"))
    keyed = keyed.select("owner", "r", "act", F.explode(F.array_distinct(F.array(F.trim("r.resource_arn"), F.lit("*")))).alias("place"))
    return keyed.join(owned_statements(edges, statements), ["owner", "act", "place"]).where(statement_applies("s", "r")).select("r.req_id", "s.effect")


def governing_policies(edges: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """(principal, policy): attached to it or to its groups, and inline ones (owner, policy); duplicates stay."""
    attached = edges.where("relation = 'AttachedWith'").select(F.col("src").alias("owner"), F.col("dst").alias("policy"))
    owned = attached if inline is None else attached.unionByName(inline.select("owner", "policy"))
    member = edges.where("relation = 'MemberOf'").select(F.col("src").alias("principal"), F.col("dst").alias("owner"))
    return owned.withColumnRenamed("owner", "principal").unionByName(member.join(owned, "owner").select("principal", "policy"))


def governing_counts(edges: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """(principal, n, first): of the rows of ``governing_policies``, inline ones included, their number and least policy, counted by
    owner before members meet them, so that the rows themselves are never made."""
    attached = edges.where("relation = 'AttachedWith'").select(F.col("src").alias("owner"), F.col("dst").alias("policy"))
    each = attached if inline is None else attached.unionByName(inline.select("owner", "policy"))
    owned = each.groupBy("owner").agg(F.count("*").alias("n"), F.min("policy").alias("first"))
    member = edges.where("relation = 'MemberOf'").select(F.col("src").alias("principal"), F.col("dst").alias("owner"))
    each = owned.withColumnRenamed("owner", "principal").unionByName(member.join(owned, "owner").drop("owner"))
    return each.groupBy("principal").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def resolve_principals(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(name) -> (name, id): by arn, else by id, else by arn whatever its case."""
    by = lambda key, name, rank: asked.join(nodes.select(key.alias("k"), F.col("id")), name == F.col("k")).select("name", "id", F.lit(rank).alias("rank"))
    found = by(F.col("arn"), F.col("name"), 0).unionByName(by(F.col("id"), F.col("name"), 1)).unionByName(by(F.lower("arn"), F.lower("name"), 2))
    return found.groupBy("name").agg(F.min(F.struct("rank", "id")).alias("best")).select("name", F.col("best.id").alias("id"))


def evaluate_on_graph(requests: DataFrame, nodes: DataFrame, edges: DataFrame, statements: DataFrame, trust: DataFrame, guarded: DataFrame | None = None) -> DataFrame:
    """(req_id, decision): policies govern principals, and a role's trust statements (policy_id = role id) come first.

    An unknown principal, or one without policies, is implicitly denied. Taking on a role that has a trust policy
    needs that policy's Allow before the principal's own. guarded: (id) of roles that have a trust policy even if no
    statement is left in it; None: those that ``trust`` names.
    """
    names = lambda c: resolve_principals(nodes, requests.select(F.col(c).alias("name")).distinct())
    known = requests.join(names("principal_arn").withColumnRenamed("name", "principal_arn"), "principal_arn", "left")
    known = known.join(names("resource_arn").select(F.col("name").alias("resource_arn"), F.col("id").alias("role")), "resource_arn", "left")
    return evaluate_known(step(known), edges, statements, trust, guarded)


def evaluate_known(known: DataFrame, edges: DataFrame, statements: DataFrame, trust: DataFrame, guarded: DataFrame | None = None) -> DataFrame:
    """The same for requests that carry ``id``, the principal's node, and ``role``, the resource's; either may be null."""
    said = owned_effects(known, edges, statements).withColumn("sid", F.lit(None).cast("string"))  # the decision alone is asked
    own = _decided(said, known).select("req_id", F.col("decision").alias("own"))
    barred = (trust.select(F.col("policy_id").alias("role")) if guarded is None else guarded.select(F.col("id").alias("role"))).distinct()
    takes = known.where(normal_action(F.col("action")) == "sts:assumerole").join(barred, "role", "left_semi")
    gate = _decided(governed_matches(takes.withColumn("policy_id", F.col("role")), trust).select("r.req_id", "s.effect", "s.sid"), takes).select("req_id", F.col("decision").alias("gate"))
    return own.join(gate, "req_id", "left").select("req_id", F.when(F.col("gate") != "Allow", F.col("gate")).otherwise(F.col("own")).alias("decision"))


def grants_all(statements: DataFrame) -> DataFrame:
    """(policy_id): policies with an Allow of every action, ``*`` or ``*:*``, on every resource, ``*``."""
    every = lambda c, names: F.coalesce(F.exists(c, lambda x: F.trim(x).isin(*names)), F.lit(False))
    return statements.where((F.col("effect") == "Allow") & every("action", ["*", "*:*"]) & every("resource", ["*"])).select("policy_id").distinct()


def conformance(decisions: DataFrame) -> DataFrame:
    """One row: (n, denied, conforming, denied_ids)."""
    bad = F.col("decision") != "Allow"
    return decisions.agg(F.count("*").alias("n"), F.count_if(bad).alias("denied"), F.coalesce(F.bool_and(~bad), F.lit(True)).alias("conforming"), F.array_sort(F.collect_list(F.when(bad, F.col("req_id")))).alias("denied_ids"))


def expand_actions(patterns: DataFrame, universe: DataFrame, fallback: bool = True) -> DataFrame:
    """patterns(pattern) over universe(action): canonical names; a pattern that matches none stays, if asked."""
    p = patterns.select(F.trim("pattern").alias("pattern")).where("pattern <> ''").distinct()
    wild = F.contains("pattern", F.lit("*")) | F.contains("pattern", F.lit("?"))
    u = universe.select(F.col("action").alias("name")).distinct()
    exact = p.where(~wild).join(u, normal_action(F.col("pattern")) == normal_action(F.col("name")), "left")
    loose = p.where(wild).join(u, action_matches(F.col("name"), F.col("pattern")), "left")
    found = exact.unionByName(loose)
    return found.select(F.coalesce("name", "pattern" if fallback else "name").alias("action")).where("action is not null").distinct()


def expand_not_actions(patterns: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.select("action").distinct().join(expand_actions(patterns, universe, False), "action", "left_anti")
