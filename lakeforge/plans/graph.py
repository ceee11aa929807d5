"""The first pass: summaries for all pending functions, children before callers, in set-wise rounds.

Every pending function is a root, so all first calls are one stage; an audited child without a summary is analysed
anew with its callers, down to max_depth.  Enrichment goes up from the leaves: a round takes the functions whose children
are all final; if a round finds none, what is left holds cycles, which are opened: the first function of a cycle is the one that a walk
would still have under way, so its callers there see the stub for it, and it sees their summaries.  A child counts once it
is extracted or audited, or its name has a summary; one that failed counts but for the caller that met it first, and one that
lies deeper than max_depth below the root that a walk comes from doesn't count for its caller (`met`).
A failed enrichment keeps the first summary (compat: blanks it).

Functions are IN_PROGRESS until their summary is final, which alone is stored: after a crash the next start takes up
those that are left, with the answers that the log already has.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..operators.lookup import by_status, contexts, has_summary, internal_edges, to_descend
from ..operators.parse import bodies
from ..operators.state import StateStore, finalise, save_dependencies, transition
from ..schemas import AUDITED, EXTRACTED, FAILED, IN_PROGRESS, PENDING
from ..session import cut_lineage as _cut_lineage
from ..sources.replies import ReplyLog
from .config import Config
from .infer import Model, discover, reply_dependencies
from .progress import Progress

log = logging.getLogger(__name__)


def cut_lineage(df: DataFrame, tag: str = "cut") -> DataFrame:
    """As in session, for tables that join step by step: they are never broadcast, for broadcasts go through the driver, and one for
    each step adds up to many times the graph."""
    return _cut_lineage(df, tag).hint("merge")


def summary_prompt() -> Column:
    return F.concat(
        F.lit("You read Go code. Say in at most 45 words what the function does, and list what it depends on.\nAnswer with JSON: "),
        F.lit('{"summary": "text", "external": [{"name": "Load", "type": "function"}]}\nFUNCTION: '), "id", F.lit("\nKNOWN DEPENDENCIES:\n"), "context", F.lit("\nCODE:\n"), "code",
    )


def prompts(ids: DataFrame, functions: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    rows = functions.join(ids.select("id"), "id", "left_semi")
    rows = rows.select("id").join(bodies(rows, files), "id").join(contexts(ids, dependencies, functions), "id")
    return rows.select("id", summary_prompt().alias("prompt"), (F.col("code") != "").alias("has_code"))


COMPACT = 8  # levels after which what has been seen is written as one table again


def reached(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: what edges(a, b) reach from roots(node), whose depth is 1; nothing beyond max_depth, and no node twice."""
    front = cut_lineage(roots.select("node").distinct().withColumn("depth", F.lit(1)), "front")
    seen = front
    for depth in range(2, max_depth + 1):
        step = front.join(edges, front.node == edges.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut_lineage(step.withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
        if depth % COMPACT == 0:
            seen = cut_lineage(seen.coalesce(max(1, seen.sparkSession.sparkContext.defaultParallelism)), "seen")
    return seen


def _spread(labels: DataFrame, edges: DataFrame, best) -> DataFrame:
    """Carries labels(node, label) along edges(a, b) to the end."""
    while True:
        near = labels.join(edges, labels.node == edges.a).groupBy(F.col("b").alias("node")).agg(best("label").alias("near"))
        new = cut_lineage(labels.join(near, "node", "left").select("node", "label", best_of(best, "label", "near")), "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            return labels


def best_of(best, a: str, b: str) -> Column:
    return (F.greatest if best is F.max else F.least)(F.col(a), F.coalesce(b, a)).alias("new")


def _strong(edges: list[tuple[str, str]]) -> dict[str, str]:
    """node -> least member of its strong component, for nodes on cycles: components of two nodes or more, and loops (Tarjan, with a
    stack of its own)."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    number, low, held, on, found = {}, {}, [], set(), {a: a for a, b in edges if a == b}
    for root in out:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            child = next(rest, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(held.pop())
                    on.difference_update(own)
                    if len(own) > 1:
                        found |= dict.fromkeys(own, min(own))
            elif child not in number:
                number[child] = low[child] = len(number)
                held.append(child)
                on.add(child)
                work.append((child, iter(out.get(child, ()))))
            elif child in on:
                low[node] = min(low[node], number[child])
    return found


SMALL = 5_000  # edges that may come to the driver


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id, component: every node of edges(function_id, child) that reaches itself, with the least member of its strong component. What is
    left once there are `small` edges is searched on the driver, which spares a job for each step.

    Nodes without a way in or out are trimmed; of the rest, a node's label is the greatest node that reaches it, and
    the nodes from which the label's own node can be reached with the same label are its component.  Those go, and the search
    goes on with what is left. State grows with the edges, never with the pairs.
    """
    spark = edges.sparkSession
    left = cut_lineage(edges.select(F.col("function_id").alias("a"), F.col("child").alias("b")).distinct(), "cycle-edges")
    loops = left.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    found, size = loops.limit(0), left.count()
    while size > small:
        trimmed = left.where("a <> b").join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        trimmed = cut_lineage(trimmed, "cycle-edges")
        left, before, size = trimmed, size, trimmed.count()
        if size < 0.9 * before or not size:
            continue
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        color = _spread(nodes.withColumn("label", F.col("node")), left, F.max)
        a, b = color.select(F.col("node").alias("a"), F.col("label").alias("la")), color.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        inside = cut_lineage(left.join(a, "a").join(b, "b").where("la = lb").select(F.col("b").alias("a"), F.col("a").alias("b")), "cycle-inner")  # backwards
        roots = color.where("node = label").join(inside.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        own = cut_lineage(reached(inside, roots, 1 << 30).join(color, "node").select("node", "label"), "cycle")
        several = own.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.union(own.join(several, "label").select(F.col("node").alias("id"), "component"))
        gone = color.where("node = label").select("node").union(own.select("node")).distinct()
        left = cut_lineage(left.join(gone, left.a == gone.node, "left_anti").join(gone, left.b == gone.node, "left_anti"), "cycle-edges")
        size = left.count()
    if size:
        rest = _strong([(r.a, r.b) for r in left.where("a <> b").collect()])
        found = found.union(spark.createDataFrame(sorted(rest.items()), found.schema))
    return found.union(loops.join(found.select("id"), "id", "left_anti"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """function_id, child: edges between components; a node outside of cycles is its own. There are no cycles in it."""
    components = components.hint("merge")
    a, b = (components.select(F.col("id").alias(c), F.col("component").alias(f"own_{c}")) for c in ("function_id", "child"))
    rows = edges.join(a, "function_id", "left").join(b, "child", "left")
    rows = rows.select(F.coalesce("own_function_id", "function_id").alias("function_id"), F.coalesce("own_child", "child").alias("child"))
    return rows.where("function_id <> child").distinct()


def on_cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id of every node of edges(function_id, child) that reaches itself."""
    return strong_components(edges, small).select("id")


def opened(edges: DataFrame, order: DataFrame) -> DataFrame:
    """edges without those that lead, within a component that calls no other, to its first member by order(id, seq): that member is the one
    a walk from it meets while it's under way, so its callers there see the stub, and it sees them."""
    components = cut_lineage(strong_components(edges), "components")
    above = condensed(edges, components).select(F.col("function_id").alias("component")).distinct()
    lowest = components.join(above, "component", "left_anti").join(order, "id", "left")
    first = lowest.groupBy("component").agg(F.min(F.struct(F.coalesce("seq", F.lit((1 << 62))), F.col("id"))).alias("first")).select("component", F.col("first.id").alias("child"))
    back = edges.join(components.withColumnRenamed("id", "function_id"), "function_id").join(first, ["component", "child"]).select("function_id", "child")
    return edges.join(back, ["function_id", "child"], "left_anti")


def rounds(edges: DataFrame, most: int, order: DataFrame | None = None) -> Iterator[DataFrame]:
    """The nodes that edges(function_id, child) start from, round by round: those whose children have all been taken or have
    no children; where there are none, cycles are opened at their first member by order(id, seq)."""
    edges = cut_lineage(edges.where("function_id <> child").select("function_id", "child").distinct(), "edges")
    left = cut_lineage(edges.select(F.col("function_id").alias("id")).distinct(), "left")
    order = left.select("id", F.lit(0).alias("seq")) if order is None else order
    for _ in range(most):
        while True:
            if not left.limit(1).count():
                return
            open_edges = edges.join(left.withColumnRenamed("id", "child"), "child", "left_semi").join(left.withColumnRenamed("id", "function_id"), "function_id", "left_semi")
            ready = cut_lineage(left.join(open_edges.select(F.col("function_id").alias("id")), "id", "left_anti"), "ready")
            if ready.limit(1).count():
                break
            edges = cut_lineage(opened(open_edges, order), "edges")
        yield ready
        left = cut_lineage(left.join(ready, "id", "left_anti"), "left")


def _deep(edges: DataFrame, depth: int) -> bool:
    """Whether there is a path of more than `depth` nodes (of any length, on a cycle)."""
    at = cut_lineage(edges.select(F.col("function_id").alias("id")).distinct(), "deep")
    for _ in range(depth):
        if not at.limit(1).count():
            return False
        at = cut_lineage(at.join(edges, at.id == edges.function_id).select(F.col("child").alias("id")).distinct(), "deep")
    return bool(at.limit(1).count())


MOST_STEPS = 200


def visits(edges: DataFrame, own: DataFrame, max_depth: int) -> DataFrame:
    """id, root, depth: from which root of own(id, seq) a walk in the order of seq meets each function first, and how deep; a walk goes
    along edges(function_id, child), not below max_depth. Of several ways from one root the shortest counts.

    A function's root is its own or the least that one of its callers hands down; that is worked out anew in each step, from the
    callers' present roots, until nothing changes, for a caller that turns out to lie deeper may hand down no more.
    """
    own = own.select("id", F.struct(F.col("seq").alias("root"), F.lit(1).alias("depth")).alias("first"))
    labels = cut_lineage(own.select("id", "first.*"), "visits")
    for _ in range(MOST_STEPS):
        handed = labels.where(F.col("depth") < max_depth).join(edges, labels.id == edges.function_id)
        handed = handed.groupBy(F.col("child").alias("id")).agg(F.min(F.struct("root", (F.col("depth") + 1).alias("depth"))).alias("via"))
        new = cut_lineage(own.join(handed, "id", "left").select("id", F.least("first", "via").alias("v")).select("id", "v.*"), "visits")
        before = labels.select("id", F.col("root").alias("r"), F.col("depth").alias("d"))
        labels = new
        if not new.join(before, "id").where("root <> r or depth <> d").limit(1).count():
            break
    return labels


def met(edges: DataFrame, ran: DataFrame, max_depth: int) -> DataFrame:
    """The edges(function_id, child) whose caller finds its child resolved, where both are of ran(id, ok, seq), the functions of this run.

    A walk takes the functions as roots in the order of seq, and children before callers.  A child that lies too deep for the walk that
    meets its caller is visited later, as a root, and isn't resolved for it.  A failed child is resolved for all that may still
    descend to it but the caller that meets it first, for which it fails.
    """
    failed = ran.where(~F.col("ok")).select(F.col("id").alias("child"))
    if not edges.join(failed, "child", "left_semi").limit(1).count() and not _deep(edges, max_depth):
        return edges
    found = cut_lineage(visits(edges, ran, max_depth), "visits")
    a = found.select(F.col("id").alias("function_id"), F.col("root").alias("from"), F.col("depth").alias("level"))
    b = found.join(ran.select("id", "ok", "seq"), "id").select(F.col("id").alias("child"), "root", "ok")
    rows = cut_lineage(edges.join(a, "function_id").join(b, "child").join(ran.select(F.col("id").alias("function_id"), "seq"), "function_id").where(F.col("root") <= F.col("from")).where(F.col("ok") | (F.col("level") < max_depth)), "met")
    first = rows.where("root = from and not ok").groupBy("child").agg(F.min(F.struct("level", "seq", "function_id")).alias("f")).select("child", F.col("f.function_id").alias("function_id"))
    return rows.select("function_id", "child").join(first, ["function_id", "child"], "left_anti")


def heights(edges: DataFrame, most: int) -> DataFrame:
    """id, height: the round in which each caller is taken, from 1."""
    out = edges.select(F.col("function_id").alias("id"), F.lit(0).alias("height")).limit(0)
    for k, ready in enumerate(rounds(edges, most), 1):
        out = out.union(ready.select("id", F.lit(k).alias("height")))
    return out


def _discovered(store: StateStore, ids: DataFrame, files: DataFrame, model: Model, config: Config, answers: ReplyLog | None) -> DataFrame:
    """First replies of the ids, which are claimed first; failures and dependencies are stored."""
    store.change(transition, ids.select("id", F.lit(IN_PROGRESS).alias("status")))
    first = cut_lineage(prompts(ids, store.read("functions"), store.read("dependencies"), files), "prompts")
    replies = cut_lineage(discover(first, model, config.workers, log=answers), "replies")
    told = replies.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).alias("again"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s")).first()
    log.info("first replies: %d functions, %d retries, %d failures, %.1f s of calls", told.n, told.again, told.bad, told.s)
    failed = replies.where("not ok").select("id", F.lit(FAILED).alias("status"))
    store.change(transition, failed, dependencies=save_dependencies(store.read("dependencies"), reply_dependencies(replies)))
    if told.bad and config.fail_fast:
        raise RuntimeError(f"{told.bad} functions could not be analysed; what is done is stored")
    return replies


def run_pass(store: StateStore, files: DataFrame, model: Model, config: Config, answers: ReplyLog | None = None) -> None:
    todo = cut_lineage(by_status(store.read("functions"), PENDING).select("id"), "pending")
    total = todo.count()
    log.info("pending functions: %d", total)
    replies, progress = None, Progress(total)
    for depth in range(1, config.max_depth + 1):
        if not todo.limit(1).count():
            break
        with progress.following(answers.count if answers else None):
            new = _discovered(store, todo, files, model, config, answers)
        replies = new if replies is None else cut_lineage(replies.union(new), "replies")
        functions = store.read("functions")
        again = to_descend(reply_dependencies(new), functions).select(F.col("child").alias("id")).distinct()
        todo = cut_lineage(again.join(functions.where(F.col("status") == AUDITED), "id", "left_semi"), "descended")
        log.info("depth %d: %d audited children without a summary", depth, todo.count())
    if replies is None:
        return
    good = cut_lineage(replies.where("ok").select("id", "summary"), "good")
    functions = store.read("functions")
    dependencies = reply_dependencies(replies)
    told = has_summary(dependencies.select("dep_name").distinct(), functions)
    ran = cut_lineage(replies.select("id", "ok").join(functions.select("id", "seq"), "id"), "ran")
    before = functions.where(F.col("status").isin(EXTRACTED, AUDITED, FAILED)).select(F.col("id").alias("child")).join(ran.select(F.col("id").alias("child")), "child", "left_anti")
    edges = cut_lineage(internal_edges(dependencies, functions).join(good.select(F.col("id").alias("function_id")), "function_id", "left_semi").select("function_id", "child", "dep_name").distinct(), "calls")
    named = edges.join(told, "dep_name", "left_semi").select("function_id", "child")
    others = edges.join(told, "dep_name", "left_anti").select("function_id", "child").distinct()
    inside = cut_lineage(others.join(ran.select(F.col("id").alias("child")), "child", "left_semi").select("function_id", "child"), "inside")
    known = named.union(others.join(before, "child", "left_semi").select("function_id", "child"))
    edges = cut_lineage(known.union(met(inside, ran, config.max_depth)).distinct(), "edges")
    enriched = cut_lineage(edges.select(F.col("function_id").alias("id")).distinct(), "enriched")
    store.change(finalise, good.join(enriched, "id", "left_anti"))
    inner = edges.join(enriched.withColumnRenamed("id", "child"), "child", "left_semi").select("function_id", "child")
    alone = enriched.join(inner.where("function_id <> child").select(F.col("function_id").alias("id")), "id", "left_anti")
    # callers of final functions alone come first, and with them those of callers that call nobody else
    marks = inner.union(alone.select("id", F.lit("").alias("child")))
    progress.tick(total - enriched.count())
    for k, ready in enumerate(rounds(marks, 1 << 30, functions.select("id", "seq")), 1):
        known = cut_lineage(prompts(ready, store.read("functions"), store.read("dependencies"), files), "prompts")
        with progress.following(answers.count if answers else None):
            again = cut_lineage(discover(known, model, config.workers, retries=0, log=answers, stage="enrich"), "again")
        kept = F.when(F.col("ok"), F.col("summary")).otherwise(F.lit("") if config.compat else F.col("first"))
        again = again.join(good.select("id", F.col("summary").alias("first")), "id").select("id", kept.alias("summary"))
        store.change(finalise, again)
        progress.tick(n := ready.count())
        log.info("round %d: %d functions enriched; %s", k, n, progress.text())
    if answers:
        answers.clear()
